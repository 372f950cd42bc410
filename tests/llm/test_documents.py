import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from textward.llm import chat_format, components, line_dedup, quality_rules, shingle_join, toxicity, vector_join
from textward.llm.html_extract import extract

DOC = "doc_id long, text string, source string, n_lines string"  # the last clashes with an output


def oracle(sql, docs):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, s, _ in docs])
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return sorted((dict(zip(names, row, strict=True)) for row in r.fetchall()), key=repr)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


def same(got, want):
    assert [{k: r[k] for k in sorted(r)} for r in got] == [{k: r[k] for k in sorted(r)} for r in want]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    line = "This Line is shared by many documents, and is long enough."
    words = [f"w{k}" for k in range(40)]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice([line, "\t" + line.upper() + " \r", line + "É", line + "é"]))
        if k % 7 == 0:
            parts += [parts[0]] * 4
        docs.append((k, "\n".join(parts), f"s{k % 4}", "x"))
    docs += [(100, None, None, None), (101, "", "s1", None), (102, " \n\t\n", None, None), (103, "a b c d e " * 200, "s2", None), (104, "k" * 30_000 + "\n" + line, "s9", None)]
    return docs


def test_line_dedup_is_the_sqls(spark, corpus):
    same(rows_of(line_dedup.report(spark.createDataFrame(corpus, DOC))), oracle(line_dedup.SQL, corpus))


def test_line_dedup_keeps_columns_nulls_and_rows(spark, corpus):
    out = line_dedup.drop_repeated_lines(spark.createDataFrame([*corpus, corpus[0], (None, "x", None, None)], DOC))
    assert out.count() == len(corpus) + 2
    assert rows_of(line_dedup.report(spark.createDataFrame([], DOC))) == []


def test_quality_rules_are_the_sqls(spark, corpus):
    same(rows_of(quality_rules.report(spark.createDataFrame(corpus, DOC))), oracle(quality_rules.SQL, corpus))


def test_repeated_words_against_brute_force(spark):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                hit |= set(range(i, i + 5))
        return len(hit)

    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.base_rules(spark.createDataFrame([(k, t, "s", "") for k, t in enumerate(texts)], DOC)).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_a_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"word{k}" for k in range(50))
    docs = [(k, good if k % 10 == 0 else "short", "bad", "") for k in range(200)] + [(1000 + k, good if k % 10 else "short", f"s{k % 5}", "") for k in range(200)]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(docs, DOC)).collect()}
    assert not any(i < 1000 for i in kept) and sum(i >= 1000 for i in kept) == 180
    assert quality_rules.keep_good(spark.createDataFrame([], DOC)).count() == 0


def brute_components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, 501 + k) for k in range(30)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(3, 3)]
    want = brute_components(links, {x for e in links for x in e})
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_brute(rows, words, percent):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    where = defaultdict(list)
    links = []
    for i, own in sets.items():
        for j, n in Counter(j for g in own for j in where[g]).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                links.append((i, j))
        for g in own:
            where[g].append(i)
    found = brute_components(links, sets)
    return {i: (len(sets[i]), found[i]) for i in sets}


@pytest.mark.parametrize(("words", "percent", "light", "block", "candidate"), [(4, 85, 8, 2000, 0.5), (5, 80, 8, 2000, 0.5), (2, 80, 1, 40, 0.5), (3, 70, 2, 2000, 1e6)])
def test_shingle_classes_against_brute_force(spark, monkeypatch, words, percent, light, block, candidate):
    monkeypatch.setattr(shingle_join, "LIGHT", light)
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    monkeypatch.setattr(shingle_join, "CANDIDATE", candidate)
    rng = random.Random(words)
    voc = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(700):
        if k and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(voc)]
        else:
            w = [rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 90]))]
        rows.append((k, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "A b"), (5004, "a  B"), (5005, "É x y z w"), (5006, "é x y z w")]
    got = shingle_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == shingle_brute(rows, words, percent)


@pytest.mark.parametrize("words", [4, 5])
def test_shingle_sets_of_few_words(words):
    texts = [" ".join("abcdef"[:n]) for n in range(7)]
    together = shingle_join.shingle_sets(pa.array([*texts, "x y z w v u t s"]), words)
    for n, text in enumerate(texts):
        for alone in ([text], ["", text, None]):
            got = shingle_join.shingle_sets(pa.array(alone, pa.string()), words)[alone.index(text)]
            assert got.tolist() == together[n].tolist() and len(got) == (max(1, n - words + 1) if n else 0)


def test_shingle_classes_of_one_short_row(spark):
    for n in range(6):
        for words, percent in ((4, 85), (5, 80)):
            docs = spark.createDataFrame([(7, " ".join("abcde"[:n]))], "doc_id long, text string").coalesce(1)
            sets = shingle_join._sets(shingle_join._rows(docs), words).collect()
            assert [(r.doc_id, r.n_shingles) for r in sets] == [(7, max(1, n - words + 1) if n else 0)]
            shingle_join._signature_rows(docs, words, percent, 1.0).collect()


def test_shingle_classes_of_nothing_and_of_copies(spark):
    schema = "doc_id long, text string, component_id string"
    assert shingle_join.classes(spark.createDataFrame([], schema)).count() == 0
    copies = spark.createDataFrame([(k, "one two three four five six", "x") for k in range(50)] + [(7, "one two three four five six", "x")], schema)
    assert {r.component_id for r in shingle_join.classes(copies).collect()} == {0}
    assert [r.doc_id for r in shingle_join.keep_first(copies).collect()] == [0]


def vectors_brute(rows, threshold):
    ok = [i for i, (v, e) in enumerate(rows) if v is not None and e is not None and np.isfinite(np.array(e, float)).all() and np.linalg.norm(e) > 0]
    links, n = [], Counter()
    for a, b in itertools.combinations(ok, 2):
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
            links.append((a, b))
            n[a] += 1
            n[b] += 1
    found = brute_components(links, range(len(rows)))
    small = {}
    for k, c in found.items():
        if rows[k][0] is not None:
            small[c] = min(small.get(c, 1 << 60), rows[k][0])
    return sorted(((v, n[k], small[found[k]] if v is not None else None) for k, (v, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("copy_cost", [2_000, 0.01])
def test_vector_links_against_brute_force(spark, monkeypatch, copy_cost):
    monkeypatch.setattr(vector_join, "BLOCK", 50)
    monkeypatch.setattr(vector_join, "COPY", copy_cost)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(15, 8))
    x = np.concatenate([base[rng.integers(0, 15, 220)] + rng.normal(size=(220, 8)) * 0.25, np.repeat(base[:1], 30, 0)])
    rows = [(k, list(map(float, e))) for k, e in enumerate(x)]
    rows[3], rows[4], rows[5], rows[6] = (3, None), (4, [0.0] * 8), (5, [float("nan")] * 8), (6, [float("inf")] * 8)
    rows += [(None, rows[0][1]), (900, [1.0, 0.0]), (901, [1.0, 0.1]), (902, [])]
    rows = [(v, e) for v, e in rows]
    got = vector_join.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == vectors_brute(rows, 0.95)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert vector_join.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "STRETCH", 3)
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "\\n", "<\\|", "a\nb", "", None, "é😀", "<|", "\\\\<|im_end|>\n"]
    rows = [(c, t, ["user", "assistant", "system", "as\nsistant", None][(c + t) % 5], odd[(c * 3 + t) % len(odd)], "x") for c in range(12) for t in range(c)]
    got = {r.conv_id: r for r in chat_format.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")).collect()}
    for c, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat_format.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_main_text():
    page = """<html><body class="has-sidebar"><header><a href=/>Home</a> Some site</header><div class="notice">We use cookies, is that fine?</div><nav><ul><li><a>One</a></ul></nav>
    <div class=wrap><article><header><h1>Title &amp; more</h1><span>by someone</span></header><p>First paragraph, with text.<br>It goes on&nbsp;and on.<p>Second, also long enough. <b>Bold</b><ul><li>Point one is here.<li>Two.</ul>
    <script>var t="</p>";</script><div class="ad">Buy, buy, buy now, and more.</div></article><section id="comments"><p>Great post! I loved it, really, so much, thanks a lot for writing, bye.</p></section></div>
    <aside>Other things, to read.</aside><form><p>Name:<input></form><footer>Copyright, 2020.</footer></body></html>"""
    assert extract(page).split("\n\n") == ["Title & more", "First paragraph, with text. It goes on and on.", "Second, also long enough. Bold", "Point one is here.", "Two."]
    assert [extract(x) for x in (None, "", "plain text only", "<p>Just one.</p>", "<!-- x", "<b>a < b")] == ["", "", "plain text only", "Just one.", "", "a < b"]
    assert extract("<div>" * 3000 + "deep, text.") == "deep, text."


def test_main_text_without_an_article_keeps_lead_and_end():
    lead, end = "A lead, short but whole.", "The closing words, at last."
    body = [f"Paragraph {k}, with some words of its own, and more of them, so that it is long." for k in range(40)]
    parts = f"<div class=lead><p>{lead}</p></div><div class=text>{''.join(f'<p>{t}</p>' for t in body)}<ul><li>Point</ul></div><div class=end><p>{end}</p></div>"
    want = [lead, *body, "Point", end]
    assert extract(f"<body><div class=page>{parts}</div></body>").split("\n\n") == want
    assert extract(f"<body><div class=menu><a href=/>Home</a></div>{parts}<div id=footer><p>Imprint, and so on.</p></div></body>").split("\n\n") == want


def test_main_text_keeps_sections_named_by_their_titles():
    p = "Some words of a paragraph, and more of them, so that it is long enough."
    own = f"""<h2 id="search">Search</h2><p>{p}</p><h3 id="share-prices">Share prices</h3><p class="responses">{p}</p><section id="discussion"><h2>Discussion and outlook</h2><p>{p}</p></section>
    <div id="related-work"><h2>Related work</h2><p>{p}</p></div><section id="header-files"><h2>Header files</h2><p>{p}</p></section><h3 id="comments">Comments</h3><p>{p}</p>"""
    want = ["Search", p, "Share prices", p, "Discussion and outlook", p, "Related work", p, "Header files", p, "Comments", p]
    noise = """<div class="ads">Buy it, now.</div><div class="social-share">Share, please.</div><div class="related"><p>See <a href=/x>another long article, of this site</a></p></div><section id="comments"><p>Great post, thanks.</p></section>"""
    assert extract(f"<body><article><p>{p}</p>{own}{noise}</article></body>").split("\n\n") == [p, *want]
    page = f"<body><div class=page><p>{p}</p><section id='discussion'><h2>Discussion</h2><p>{p}</p></section><div id='comments'><h3>Comments</h3><p>{p}</p></div></div></body>"
    assert extract(page).split("\n\n") == [p, "Discussion", p]


def test_main_text_keeps_links_of_the_article():
    p = "Some words of a paragraph, and more of them, so that it is long enough."
    own = "<div>See <a href=/x>the long title of another page</a></div><table><tr><td>Source</td><td><a href=/y>A table of prices</a></td></tr></table><ul><li><a href=/1>First source</a><li><a href=/2>Second source</a></ul>"
    want = [p, "See the long title of another page", "Source", "A table of prices", "First source", "Second source"]
    menu = "<ul><li><a href=/>Home</a><li><a href=/news>News</a></ul>"
    for tag in ("article", "main"):
        assert extract(f"<body>{menu}<{tag}><p>{p}</p>{own}</{tag}>{menu}</body>").split("\n\n") == want
    assert extract(f"<body>{menu}<div><p>{p}</p>{own}<p>{p}</p></div>{menu}</body>").split("\n\n") == [*want, p]
    assert extract(f"<body><div><p>{p}</p><p>{p}</p><div>See <a href=/x>the long title of another page</a></div>{menu}</div></body>").split("\n\n") == [p, p, want[1]]
    assert extract(f"<body><div>{menu}<p>{p}</p><p>{p}</p>{menu}</div></body>").split("\n\n") == [p, p]


def test_toxicity_learns_and_keeps_clean_documents(spark):
    rng = random.Random(5)
    voc = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(1500):
        words = [rng.choice(voc) for _ in range(40)]
        bad = k % 6 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["Idiot!", "scum"])
            words[rng.randrange(40)] = "moron,"
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(bad)))
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, " ".join(voc * 40) + " moron idiot scum moron", "x")]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(df, marks).collect()}
    held = [k for k, _ in labels if got[k].held_out]
    assert 200 < len(held) < 400
    assert sum(got[k].predicted == dict(labels)[k] for k in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9000].predicted == got[9001].predicted == 0
    kept = toxicity.keep_clean(df, marks)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id % 6 <> 0 and doc_id < 9000").count() == 1250
    assert toxicity.report(df.limit(0), marks.limit(0)).count() == 0

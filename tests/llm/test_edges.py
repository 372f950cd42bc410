"""Nulls, repeats, clashing names and missing labels, and slow versions of what SQL cannot express."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from textward.llm import common, packing, shingle_join, toxicity, vector_join

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def test_documents_stay_where_labels_are_missing_or_of_one_kind(spark):
    docs = docs_of(spark, [(k, f"word{k} other words", ) for k in range(20)])
    for labels in ([], [(k, 1, 0) for k in range(20)], [(k, 1, 1) for k in range(20)], [(k, 1, None) for k in range(20)], [(None, 1, 1), (None, 1, 0)]):
        marks = spark.createDataFrame(labels, LABEL)
        assert toxicity.keep_clean(docs, marks).count() == 20
        assert {(r.score, r.predicted) for r in toxicity.report(docs, marks).collect()} == {(0.0, 0)}


def test_the_sample_never_vanishes_and_keeps_its_bound(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id) AS text", "int(id % 2) AS label")
    for bound in (1, 10, 1000):
        n = toxicity.sample_of(rows, bound).count()
        assert n <= bound and (bound < 10 or n > bound / 2)
    assert toxicity.sample_of(rows, 4000).count() == 4000
    assert -(2**63) + 2**64 * 9 * 8000 // (10 * 10**13) > -(2**63)


def test_conflicting_and_repeated_labels_do_not_depend_on_order(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["ab", "cd", "ef", "gh", "bad" if k % 4 == 0 else "ij"]) for _ in range(30))) for k in range(400)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(400)] + [(k, 1, 0) for k in range(0, 400, 40)]
    scores = []
    for seed in (1, 2):
        random.Random(seed).shuffle(labels)
        random.Random(seed + 5).shuffle(docs)
        scores.append(rows_of(toxicity.report(docs_of(spark, docs).repartition(seed * 3), spark.createDataFrame(labels, LABEL))))
    assert scores[0] == scores[1]


def slow_ftrl(sets, labels):
    """The same learner, one coordinate at a time."""
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 1.0

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(sets)):
            own = {i: weight(i) for i in sets[k]}
            g = 1 / (1 + math.exp(-(bias + sum(own.values())))) - labels[k]
            for i, w in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
                n[i] += g * g
            bias_n += g * g
            bias -= toxicity.ALPHA / math.sqrt(bias_n) * g
    return {i: weight(i) for i in z if weight(i)}, bias


def slow_lift(sets, labels):
    """The bias's correction, a candidate at a time."""
    logits = [0.0] * len(sets)
    for f in range(3):
        w, bias = slow_ftrl([x for k, x in enumerate(sets) if k % 3 != f], [x for k, x in enumerate(labels) if k % 3 != f])
        for k in range(f, len(sets), 3):
            logits[k] = bias + sum(w.get(i, 0.0) for i in sets[k])
    clean = labels.count(0)
    costs = []
    for step in range(81):
        over = [x + 0.05 * step >= -1e-12 for x in logits]
        flagged, missed = sum(o and not y for o, y in zip(over, labels)), sum(not o and y for o, y in zip(over, labels))
        costs.append(missed * clean / (len(labels) - clean) + flagged if step == 0 or flagged <= 0.015 * clean else math.inf)
    first = min(range(81), key=lambda s: costs[s])
    last = first
    while last < 80 and math.isclose(costs[last + 1], costs[first]):
        last += 1
    return 0.05 * ((first + last) // 2)


def test_the_edge_is_lifted_where_toxic_rows_are_few_and_left_without_both_kinds():
    assert toxicity.lifted([np.array([1])] * 6, np.zeros(6)) == 0.0
    rng = np.random.default_rng(1)
    # a third of the toxic rows hold only rare words
    sets = [np.unique(np.append(rng.integers(0, 40, 6), 100 + rng.integers(0, 30) if k % 10 == 0 else [])).astype(np.int32) for k in range(900)]
    labels = (np.arange(900) % 10 == 0).astype(float)
    w, bias = toxicity.ftrl(sets, labels)
    up = toxicity.lifted(sets, labels)
    found = lambda lift: sum(bias + lift + w[x].sum() >= 0 for x, y in zip(sets, labels, strict=True) if y)
    assert up > 0 and found(up) >= found(0)


def slow_features(text):
    words = [s for w in (text or "").split() if (s := w.lower().strip(toxicity.EDGES))]
    stems = [w[:5] for w in words]
    grams = [(1, a, a) for a in stems] + [(2, a, a) for a in words] + [(4, a, b) for a, b in zip(stems, stems[1:])] + [(5, a, b) for a, b in zip(stems, stems[2:])]

    def bucket(kind, a, b):
        a, b = zlib.crc32(a.encode()), zlib.crc32(b.encode())
        mixed = (a * 0x9E3779B97F4A7C15 % 2**64) ^ ((b + kind) * 0xC2B2AE3D27D4EB4F % 2**64)
        return (mixed >> 40) & toxicity.MASK

    return {bucket(*g) for g in grams}


def test_weights_and_scores_against_a_slow_learner(spark):
    rng = random.Random(4)
    voc = ["Alpha", "beta,", "gamma", "delta!", "epsilonic", "zeta", "…", "--", "bad", "worse"]
    docs = [(k, None if k == 7 else " ".join(rng.choice(voc[:8] if k % 3 else voc) for _ in range(rng.randint(0, 25)))) for k in range(500)]
    labels = [(k, 1, int("bad" in (t or "") or "worse" in (t or ""))) for k, t in docs]
    want = [(k, t) for k, t in docs if zlib.crc32(str(k).encode()) % 5]
    places = {r.doc_id: r.place for r in spark.createDataFrame([(k,) for k, _ in want], "doc_id long").selectExpr("doc_id", "xxhash64('sample', doc_id) AS place").collect()}
    want.sort(key=lambda r: places[r[0]])
    sets, marks = [sorted(slow_features(t)) for _, t in want], [labels[k][2] for k, _ in want]
    weights, bias = slow_ftrl(sets, marks)
    bias += slow_lift(sets, marks)
    got = toxicity.learn(toxicity._labelled(docs_of(spark, docs), spark.createDataFrame(labels, LABEL)))
    assert set(got[0].tolist()) == set(weights) and np.allclose(got[1], [weights[i] for i in got[0].tolist()]) and math.isclose(got[2], bias, abs_tol=1e-9)
    for r in toxicity.report(docs_of(spark, docs), spark.createDataFrame(labels, LABEL)).collect():
        assert math.isclose(r.score, 1 / (1 + math.exp(-bias - sum(weights.get(i, 0) for i in slow_features(docs[r.doc_id][1])))), abs_tol=1e-9)


BASE = [f"w{k}" for k in range(60)]


def near(n):
    return " ".join([*BASE[:-n], *(f"x{n}{k}" for k in range(n))]) if n else " ".join(BASE)


def test_keep_first_tells_rows_apart_by_id_and_text(spark):
    other = " ".join(f"o{k}" for k in range(60))
    rows = [(1, near(0)), (2, near(1)), (2, other), (1, near(0)), (None, near(2)), (None, "alone in the world it is"), (3, None), (3, None), (4, ""), (5, near(0)), (None, other)]
    kept = shingle_join.keep_first(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, near(0)), (2, other), (None, "alone in the world it is"), (3, None), (3, None), (4, "")], key=repr)


def test_near_copies_under_null_ids_are_linked(spark):
    rows = [(None, near(0)), (None, near(1)), (9, near(2)), (None, "not the same as the others at all")]
    got = shingle_join.classes(docs_of(spark, rows), 4, 85).collect()
    assert Counter(r.component_id for r in got) == {9: 3, None: 1}
    assert shingle_join.keep_first(docs_of(spark, [(None, near(0)), (None, near(1)), (None, near(0))])).count() == 1


def shortest(lengths, capacity):
    """The least number of sequences, by trying every first fit of every order."""
    best = len(lengths)
    for order in set(itertools.permutations(lengths)):
        bins = []
        for n in order:
            k = next((k for k, b in enumerate(bins) if b + n <= capacity), None)
            if k is None:
                bins.append(n)
            else:
                bins[k] += n
        best = min(best, len(bins))
    return best


def test_packing_against_the_optimum():
    rng = random.Random(6)
    worse = 0
    for _ in range(120):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        bins = packing.plan(Counter(lengths), 20)
        assert Counter(n for own, k in bins for n in own * k) == Counter(lengths) and all(sum(own) <= 20 for own, _ in bins)
        n = sum(k for _, k in bins)
        best = shortest(lengths, 20)
        assert n <= best + 1
        worse += n > best
    assert worse <= 6


def test_vectors_without_structure_are_written_about_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4_000, 64))
    x[1::40] = x[::40] + rng.normal(size=(100, 64)) * 0.02
    written = {}
    keep = vector_join.saved
    monkeypatch.setattr(vector_join, "saved", lambda df, what: written.setdefault(what, keep(df, what)))
    monkeypatch.setattr(vector_join, "BLOCK", 100)
    got = vector_join.linked(spark.createDataFrame([(k, list(map(float, e))) for k, e in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert sorted(r.vec_id for r in got if r.n_links) == sorted([*range(0, 4_000, 40), *range(1, 4_000, 40)])
    # one cell in 40 blocks: none of its vectors is copied, though each meets all others
    assert written["blocks"].selectExpr("sum(length(ids)) div 8 AS n").first().n <= vector_join.COPIES * len(x)
    assert vector_join.choose_pivots(x / np.linalg.norm(x, axis=1, keepdims=True), 1_000_000_000, math.sqrt(0.1)).shape[0] <= 2


def test_clustered_vectors_are_dealt_to_many_cells():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.repeat(centres, 80, axis=0) + rng.normal(size=(960, 16)) * 0.02
    x = x[rng.permutation(960)] / np.linalg.norm(x, axis=1, keepdims=True)[rng.permutation(960)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = vector_join.choose_pivots(x, 1_000_000, math.sqrt(0.1))
    home, inside = vector_join._copies(x, pivots, math.sqrt(0.1))
    assert len(pivots) > 1 and np.bincount(home).max() < len(x) / 2
    close = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    shared = (inside[close[:, 0]] & inside[close[:, 1]] & ((home[close[:, 0], None] == np.arange(len(pivots))) | (home[close[:, 1], None] == np.arange(len(pivots))))).sum(axis=1)
    assert (shared == 1).all()


def test_work_needs_a_shared_folder_beyond_one_machine():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_dir(Session(), "x")


# --- the pipeline's stages, one by one, against plain versions on the same input ---


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def slow_quality(rows):
    def failed(t):
        w = words(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w) < 10 or 100 * len(hit) > 20 * len(w)

    fails = [failed(r[1]) for r in rows]
    hosts = {}
    for r, f in zip(rows, fails, strict=True):
        hosts.setdefault(r[3], []).append(f)
    n = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / n
    between = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in hosts.values())
    rest = n - sum(len(x) ** 2 for x in hosts.values()) / n - (len(hosts) - 1)
    strength = 100.0
    if 0 < mean < 1 and rest > 0:
        alike = (between / (mean * (1 - mean)) - (len(hosts) - 1)) / rest
        strength = min(10_000.0, max(1.0, 1 / alike - 1)) if alike > 0 else 10_000.0
    bad = {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) > 0.5}
    return [r for r, f in zip(rows, fails, strict=True) if not f and r[3] not in bad]


@pytest.mark.parametrize("size", [2, 50, 500])
def test_the_prior_follows_how_hosts_differ_not_their_size(size):
    from textward.llm import quality_rules

    rng = np.random.default_rng(2)

    def strength(rates):
        failed = rng.binomial(size, rates)
        n = np.full(len(rates), size)
        return quality_rules.prior(len(n), float(n.sum()), float(failed.sum()), float((n * n).sum()), float((failed * failed / n).sum()))

    mean, alike = strength(np.full(4000, 0.1))
    assert abs(mean - 0.1) < 0.02 and alike > 30
    mean, mixed = strength(rng.beta(0.5, 4.5, 4000))
    assert abs(mean - 0.1) < 0.02 and 3 < mixed < 8  # five, by which they are dealt
    assert quality_rules.prior(0, 0.0, 0.0, 0.0, 0.0) == (0.0, 100.0) and quality_rules.prior(1, 9.0, 3.0, 81.0, 1.0)[1] == 100.0


def slow_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for k, r in enumerate(rows):
        for line in set(map(key, (r[1] or "").split("\n"))):
            if len(line) >= 40:
                where.setdefault(line, []).append(k)
    rank = lambda i: -1 if i is None else i
    last = {x: max(rank(rows[k][0]) for k in at) for x, at in where.items() if len(at) >= 5}
    out = []
    for r in rows:
        text = "\n".join(x for x in (r[1] or "").split("\n") if last.get(key(x), rank(r[0])) == rank(r[0]))
        out.append((r[0], None if r[1] is None else text, r[2], r[3], None if r[4] is None else len(text if r[1] is not None else "")))
    return out


def slow_near(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for r in rows:
        w = words(low(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    return groups


def corpus():
    rng = random.Random(11)
    voc = [f"v{k}" for k in range(90)]
    shared = "A line that many of the documents share, whatever their host is."
    rows = []
    for k in range(260):
        text = "\n".join(" ".join(rng.choice(voc) for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 5)))
        if k % 9 == 0:
            text += "\n" + (shared if k % 2 else "  " + shared.upper())
        if k % 13 == 0:
            text = " ".join(text.split(" ")[:6]) + " same words go on here" * 5
        if k % 6 == 5:
            old = rows[rng.randrange(len(rows))][1] or ""
            text = old.replace("v1 ", "changed ", 1)
        source = f"host{k % 5}"
        if k % 5 == 4 and k % 3:
            text = "too short"
        rows.append((k, text, "en", source, len(text)))
    rows += [rows[3], rows[3], (rows[8][0], "the same id with words of its own, more than ten of them, so it may stay", "de", None, None), (None, rows[20][1], "fr", "host0", 1), (None, None, None, None, None), (700, "", "en", "host1", 0), (701, " ".join(voc * 40), "en", "host1", 5)]
    return rows


def test_each_stage_against_a_slow_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(k, 1, int("v7 " in (r[1] or ""))) for k, r in enumerate(rows) if r[0] == k], LABEL).write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, given):
        return [tuple(r) for r in stages[name](spark, spark.createDataFrame(given, DOC), str(tmp_path)).collect()]

    scores = {(r.doc_id, r.text): r.score for r in toxicity.score(spark.createDataFrame(rows, DOC), toxicity.learn(toxicity._labelled(spark.createDataFrame(rows, DOC), spark.read.parquet(f"{tmp_path}/labels.parquet"))), ["doc_id", "text"]).collect()}
    kept = run("toxicity", rows)
    assert sorted(kept, key=repr) == sorted([r for r in rows if scores[r[0], r[1]] < 0.5], key=repr) and 0 < len(kept) < len(rows)
    good = run("quality rules", rows)
    assert sorted(good, key=repr) == sorted(slow_quality(rows), key=repr) and not any(r[3] == "host4" for r in good)
    lines = run("line dedup", good)
    assert sorted(lines, key=repr) == sorted(slow_lines(good), key=repr) and lines != good
    found = sorted(run("n-gram Jaccard join", lines), key=repr)
    groups = slow_near(lines)
    assert len(found) == len(groups)
    for own in groups.values():
        assert sum(lines[k] in found for k in own) >= 1
        best = min((lines[k] for k in own), key=lambda r: (r[0] is None, r[0] or 0))
        assert any(r[0] == best[0] for r in found if r[1] in {lines[k][1] for k in own})
    pieces = run("best-fit packing", found)
    assert sum(p[1] == 0 for p in pieces) == len(found) and all(p[3] <= 1024 for p in pieces)


def test_the_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABEL).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sets_beyond_the_bands_at_hand_are_dealt_alike(spark, monkeypatch):
    docs = docs_of(spark, [(k, near(k % 4) if k < 8 else near(60 - k)) for k in range(16)])
    once = rows_of(shingle_join.classes(docs, words=4, percent=85))
    monkeypatch.setattr(shingle_join, "LARGEST", 5)
    assert rows_of(shingle_join.classes(docs, words=4, percent=85)) == once and len({r[2] for r in once}) < 16


def test_every_doc_id_comes_back_from_the_store(spark):
    import public_tokenizers

    from textward.llm import token_store

    ids = [-(2**63), None, 2**63 - 1, 0, -1, None, -(2**63), 7, 8, 9]
    got = token_store.token_store(docs_of(spark, [(i, f"text {k}") for k, i in enumerate(ids)]), public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(ids, key=repr)

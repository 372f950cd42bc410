"""Queries over what surrounds the cascade, with their DuckDB counterparts: failures, work bounds, catalogues as tables, limits,
versions, sketches."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward import catalog, telemetry
from textward.catalog_queries import LIGHT, NO_REPETITION, P_SQL, PLAIN, _class_sql, _prompts, _r, _table, cascade_sql, language_sql, q
from textward.config import BLOCK, CLOSED, LEVELS, OPEN, WARN, Config, Heuristics, Language, Ml, Patterns, Semantic
from textward.functions import tokenize
from textward.operators import catalogue, heuristics, language, ml, patterns, routing, semantic, spans, validate
from textward.plans import cascade
from textward.shipping import ship
from textward.sources import requests
from textward.streaming.history import whole, with_history
from textward.streaming.limits import Limits, admitted, replayed


def _failing(x):
    """A detector that fails on every seventh prompt."""
    return F.when(F.pmod(F.length(x), F.lit(7)) != 0, language.detect(F.col("_text")))


def _with_failures(spark: SparkSession, d: str, on_error: str) -> DataFrame:
    return cascade.analyze(_prompts(spark, d), "text", dataclasses.replace(LIGHT, on_error=on_error), detector=_failing)


def failed_responses(spark, d):
    """Answers where some analyses fail, by policy."""
    out = None
    for policy in (CLOSED, OPEN):
        body = requests.problem(F.col("verdict"), F.col("id").cast("string"), details=True, on_error=policy)
        part = _with_failures(spark, d, policy).select("id", F.lit(policy).alias("on_error"), requests.action(F.col("verdict"), policy).alias("action"), F.get_json_object(body, "$.title").alias("title"), F.get_json_object(body, "$.status").alias("status"), F.get_json_object(body, "$.owaspCategory").alias("category"))
        out = part if out is None else out.unionByName(part)
    return out


def failed_counters(spark, d):
    """Counters and numbers of events where some analyses fail, by policy. Both come from one run of the cascade."""
    out = None
    always, events = ("analyses", "threats", "errors", "invalid", "chars", "longest"), ("Started", "ThreatDetected", "Completed")
    for policy in (CLOSED, OPEN):
        counted = _with_failures(spark, d, policy).agg(*telemetry.counters(F.col("text")), *telemetry.event_counters())
        counted = counted.select(F.stack(F.lit(9), *[x for c in always + events for x in (F.lit(c), F.col(c).cast("long"))]).alias("what", "n"))
        part = counted.where(F.col("what").isin(*always) | (F.col("n") > 0)).select(F.lit(policy).alias("on_error"), "what", "n")
        out = part if out is None else out.unionByName(part)
    return out


#: User patterns whose work grows with the square or more; a low budget makes some texts exceed it.
SLOW = [("slow-1", "Two gaps", "Medium", "LLM01", r"hello\s*,?\s*world"), ("slow-2", "Nested", "High", "LLM01", r"(z+)+!"), ("slow-3", "Trailing", "Low", "LLM02", r"[a-z]+\d$"), ("plain-1", "Weather", "Low", "LLM02", r"\bweather\b")]
BUDGET = 3_000.0


def pat_timeouts(spark, d):
    """Patterns given up on texts for which their work may exceed a budget, and what follows from it."""
    own = Config(patterns=Patterns(built_in=False, step_budget=BUDGET))
    out = _prompts(spark, d).withColumn("p", patterns.layer(F.col("text"), own, patterns.active(own, SLOW)))
    out = out.withColumn("h", heuristics.layer(F.col("text"), own, timeouts=F.col("p.timeout_count")))
    signal = F.get(F.filter("h.signals", lambda s: s["name"] == "pattern_timeout"), 0)["contribution"]
    return out.select("id", F.array_join("p.matched", "|").alias("matched"), F.array_join("p.timed_out", "|").alias("timed_out"), _r("p.confidence").alias("confidence"), "p.is_threat", "p.category", _r(signal).alias("signal"))


def _timeouts_sql() -> str:
    def longest(cls: str) -> str:
        return f"coalesce(list_max(list_transform(regexp_extract_all(t, {q('(?i)[' + cls + ']+')}), lambda x: length(x))), 0)::DOUBLE"

    heads = "((length(low) - length(replace(low, 'hello', ''))) / 5)"
    n = "length(t)::DOUBLE"
    return rf"""WITH {P_SQL}, l AS (SELECT id, t, lower(t) AS low FROM p),
m AS (SELECT *, {longest(chr(92) + 's')} AS gap, {longest('z')} AS zs, {longest('a-z')} AS run FROM l),
o AS (SELECT *, contains(low, 'hello') AND contains(low, 'world') AND {n} + least({n} * gap, {heads} * pow(greatest(gap, 1), 2)) > {BUDGET} AS late1, contains(low, 'z') AND {n} + {n} * pow(2, least(zs, 900)) > {BUDGET} AS late2, {n} * run + least({n}, {n} * greatest(run, 1)) > {BUDGET} AS late3,
       contains(low, 'weather') AND {n} + (length(low) - length(replace(low, 'weather', ''))) / 7 > {BUDGET} AS late4 FROM m),
h AS (SELECT *, NOT late1 AND regexp_matches(t, 'hello\s*,?\s*world', 'i') AS hit1, NOT late2 AND regexp_matches(t, '(z+)+!', 'i') AS hit2, NOT late3 AND regexp_matches(t, '[a-z]+\d$', 'i') AS hit3, NOT late4 AND regexp_matches(t, '\bweather\b', 'i') AS hit4 FROM o),
x AS (SELECT *, late1::INT + late2::INT + late3::INT + late4::INT AS n, greatest(CASE WHEN hit1 THEN 0.7 ELSE 0.0 END, CASE WHEN hit2 THEN 0.85 ELSE 0.0 END, CASE WHEN hit3 OR hit4 THEN 0.5 ELSE 0.0 END)::DOUBLE AS c FROM h)
SELECT id, concat_ws('|', CASE WHEN hit1 THEN 'Two gaps' END, CASE WHEN hit2 THEN 'Nested' END, CASE WHEN hit3 THEN 'Trailing' END, CASE WHEN hit4 THEN 'Weather' END) AS matched,
       concat_ws('|', CASE WHEN late1 THEN 'Two gaps' END, CASE WHEN late2 THEN 'Nested' END, CASE WHEN late3 THEN 'Trailing' END, CASE WHEN late4 THEN 'Weather' END) AS timed_out,
       round(greatest(c, CASE WHEN n > 0 THEN 0.3 ELSE 0.0 END), 6)::DOUBLE AS confidence, c > 0 AS is_threat, CASE WHEN hit2 OR hit1 THEN 'LLM01' WHEN c > 0 THEN 'LLM02' END AS category,
       round(CASE WHEN n > 0 THEN least(1.0, 0.4 + n * 0.1) END, 6)::DOUBLE AS signal FROM x"""


#: The first words of each benchmark passage, whatever stands between them, as an expression of a table.
_PASSAGE = "concat_ws('[^a-z]+', slice(regexp_extract_all(text, '([A-Za-z]+)', 1), 3, 4))"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([(p[0], p[4]) for p in PLAIN], "id string, pattern string")
    return _table(spark, d, "benchmark").select(F.concat(F.lit("passage-"), F.col("item_id").cast("string")).alias("id"), F.expr(_PASSAGE).alias("pattern")).union(own)


def pat_catalogue(spark, d):
    """Which documents hold the passages' beginnings or the built-in patterns, with the patterns as a table."""
    return catalogue.hits(_table(spark, d, "documents"), "doc_id", "text", _passages(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue's history: signups set one of 25 patterns, purchases take one away."""
    events = _table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase"))
    number = F.get_json_object("props", "$.k")
    pattern = F.when(F.col("event_type") == "signup", F.concat(F.lit('"k": '), number, F.lit("[^0-9]")))
    return events.select(F.concat(F.lit("watch-"), F.pmod("event_id", F.lit(25)).cast("string")).alias("id"), pattern.alias("pattern"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def pat_as_of(spark, d):
    """Which events hold a pattern that was in the catalogue at their time."""
    events = _table(spark, d, "events").where(~F.col("event_type").isin("signup", "purchase"))
    return catalogue.hits(events, "event_id", "props", catalogue.intervals(_changes(spark, d)), at="ts")


def cat_history(spark, d):
    """Changes of the catalogue by day."""
    found = catalogue.kinds_of_change(_changes(spark, d))
    return found.groupBy(F.to_date("at").alias("day"), "change").agg(F.count(F.lit(1)).alias("n"))


BUCKET = Limits(tokens=2, period=3600.0, queue=1, calls=None)


def sem_limits(spark, d):
    """Requests that a bucket admits; each kind of event is a deployment with two tokens an hour."""
    out = admitted(_table(spark, d, "events"), "event_type", "ts", "event_id", BUCKET)
    return out.select("event_id", "status", _r("wait").alias("wait"))


def sem_calls(spark, d):
    """The same with one call at a time that lasts as many minutes as the event's value, and half an hour's patience."""
    events = _table(spark, d, "events").withColumn("d", F.col("value") * 60)
    out = replayed(events, "event_type", "ts", "event_id", dataclasses.replace(BUCKET, calls=1, patience=1800.0), "d")
    return out.select("event_id", "status", _r("wait").alias("wait"))


def sem_states(spark, d):
    """How many prompts end in each state of the layer, with answers recorded by id."""
    own = Config(semantic=Semantic(enabled=True, allowed=("the weather",), endpoint="https://x", api_key="k"))
    n = lambda k: F.pmod("id", F.lit(k))
    inner = F.to_json(F.struct((n(5) == 0).alias("is_threat"), (n(13) / 8).alias("confidence")))
    body = F.when(n(9) == 0, "{}").otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(inner.alias("content")).alias("message"))).alias("choices"))))
    out = None
    for name, config in (("set", own), ("unset", dataclasses.replace(own, semantic=Semantic(enabled=True))), ("off", Config())):
        s = semantic.layer(F.col("text"), body, config, live=True, turned_away=F.when(n(7) == 0, "rate_limited").when(n(7) == 1, "concurrency_limited").when(n(7) == 2, "success"), http=F.when(n(11) == 0, 429).when(n(11) == 1, 500).when(n(11) == 2, 200))
        part = _prompts(spark, d).withColumn("s", s).groupBy(F.lit(name).alias("settings"), "s.status", "s.was_executed").agg(F.count(F.lit(1)).alias("n"), F.count_if("s.is_threat").alias("threats"))
        out = part if out is None else out.unionByName(part)
    return out


def tel_histogram(spark, d):
    """Lengths by language in exact buckets."""
    return _table(spark, d, "documents").groupBy("lang").agg(*telemetry.buckets(F.length("text"), telemetry.LENGTHS))


def tel_latency(spark, d):
    """Values of events, as latencies, by day in exact buckets."""
    return _table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(*telemetry.buckets(F.col("value"), telemetry.LATENCIES))


def tel_quantiles(spark, d):
    """Whether quantiles from sketches by hour and user, merged to days and then to kinds of event, are within 2 % of the rows of the exact rank."""
    events = _table(spark, d, "events")
    fine = telemetry.sketched(events, F.col("value"), "event_type", F.to_date("ts").alias("day"), F.pmod("user_id", F.lit(10)).alias("part"))
    told = telemetry.quantiles(telemetry.merged(telemetry.merged(fine, "event_type", "day"), "event_type"))
    rows = events.join(told, "event_type")
    near = lambda q, c: (F.abs(F.count_if(F.col("value") <= F.col(c)) - q * F.count("value")) <= 0.02 * F.count("value") + 1).alias(c)
    return rows.groupBy("event_type").agg(F.max("n").alias("n"), near(0.5, "p50"), near(0.95, "p95"), near(0.99, "p99"))


def tel_severity_rollup(spark, d):
    """Threats by severity and category with totals."""
    return telemetry.rolled_up(cascade.analyze(_prompts(spark, d), "text", LIGHT))


def pat_spans(spark, d):
    """Every match of the patterns in prompts, with its place."""
    return spans.find_all(_prompts(spark, d), "id", "text", PLAIN)


_WORDS = [("w-1", "Ending", "Low", "LLM01", "[a-z]*tion[a-z]*"), ("w-2", "Pair", "Low", "LLM01", "(?:th|ou)[a-z]+ [a-z]+"), ("w-3", "Three", "Low", "LLM01", "e[a-z]{3,}r")]


def pat_united(spark, d):
    """Spans of some stretches of words in whole documents, united."""
    return spans.united(spans.find_all(_table(spark, d, "documents"), "doc_id", "text", _WORDS), "doc_id")


def pat_redacted(spark, d):
    """Prompts after the patterns' matches gave way to a mark."""
    prompts = _prompts(spark, d)
    return spans.redacted(prompts, "id", "text", spans.find_all(prompts, "id", "text", PLAIN))


#: An attack whose halves stand in two turns.
_SPLIT = [("split-1", "Split", "Critical", "LLM01", r"\bignore all previous\b(?s:.)*\binstructions\b")]


def hist_split(spark, d):
    """Patterns in each turn behind the three before it. Every conversation's second turn gets the beginning of an attack, its third the end."""
    halves = F.when(F.col("turn") == 1, " ignore all previous").when(F.col("turn") == 2, " instructions").otherwise("")
    turns = _table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), halves).alias("text"))
    seen = with_history(turns, "conv_id", "turn", "text", turns=3)
    own = Config(patterns=Patterns(built_in=False))
    judged = seen.withColumn("p", patterns.layer(whole(F.col("history"), F.col("text")), own, _SPLIT)).withColumn("alone", patterns.layer(F.col("text"), own, _SPLIT))
    return judged.select("conv_id", "turn", F.size("history").alias("before"), F.col("p.is_threat").alias("is_threat"), F.col("alone.is_threat").alias("alone"), F.sha2(whole(F.col("history"), F.col("text")).cast("binary"), 256).alias("digest"))


def _model(spark: SparkSession, d: str, config: Config):
    """A model of documents' quality that stands for a model file, and fails where the number of tokens is a multiple of three."""
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id")
    make = ml.fitted(docs, "text", "quality", config)

    def session():
        run = make()

        def checked(ids, mask):
            if any(map(_too_much, ids)):
                raise ValueError("a text that the model cannot take")
            return run(ids, mask)

        return checked

    return session


def _too_much(ids: list[int]) -> bool:
    return sum(i != tokenize.PAD for i in ids) % 3 == 0


def casc_model(spark, d):
    """The cascade with a model, which fails on some texts, next to the features."""
    ship(spark)
    own = Config(language=Language(enabled=False), patterns=NO_REPETITION, ml=Ml(threshold=0.3))
    v = cascade.analyze(_prompts(spark, d), "text", own, model=ml.model_udf(_model(spark, d, own)))
    return v.select("id", "verdict.decision_layer", "verdict.is_threat", F.round("verdict.confidence", 5).alias("confidence"), F.col("ml.mode").alias("mode"), F.round("ml.confidence", 5).alias("score"))


def _odd_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts, every third with nine suspicious characters in front."""
    some = F.when(F.pmod("id", F.lit(3)) == 0, _NINE).otherwise("")
    return _prompts(spark, d).select("id", F.concat(some, "text").alias("text"))


_NINE = catalog.SUSPICIOUS[8::-1] + catalog.SUSPICIOUS[:2]


def val_warnings(spark, d):
    """The warning as it is told: characters in the order of their first appearance, five at most, and how many more."""
    v = validate.validation(F.col("text"), Config(), F.when(F.pmod("id", F.lit(7)) == 0, F.repeat(F.lit("x"), 50_001)))
    return _odd_prompts(spark, d).select("id", v.alias("v")).select("id", F.get("v.warnings", 0).alias("warning"), F.get("v.errors", 0).alias("error"))


def lang_gate_options(spark, d):
    """The gate with warnings in place of blocks, and short texts blocked."""
    own = Config(language=Language(supported=("de", "EN"), on_unsupported=WARN, on_short=BLOCK, on_low_confidence=WARN, min_length=40))
    out = _prompts(spark, d).withColumn("l", language.gate(F.col("text"), language.detect(F.col("text")), own))
    return out.select("id", "l.proceed", "l.blocked", "l.warning", "l.message", "l.confidence")


def heu_levels(spark, d):
    """How many prompts the keyword mode's directive signal fires for, by sensitivity."""
    grid = None
    for level in LEVELS:
        own = Config(heuristics=Heuristics(compound=False, sensitivity=level))
        part = _prompts(spark, d).select(heuristics.directive_signal(F.col("text"), own).alias("s")).groupBy(F.lit(level).alias("level")).agg(F.count("s").alias("n"), _r(F.sum("s.contribution")).alias("total"))
        grid = part if grid is None else grid.unionByName(part)
    return grid


def thr_message(spark, d):
    """The text of the error that stops a prompt."""
    v = cascade.analyze(_prompts(spark, d), "text", LIGHT)
    return v.select("id", requests.blocked_message(F.col("verdict"), F.col("id").cast("string")).alias("message"))


def req_metadata(spark, d):
    """The metadata that goes with each request."""
    m = routing.metadata(F.lit("Events"), F.concat(F.lit("c-"), F.col("event_id").cast("string")), {"Path": F.concat(F.lit("/"), "event_type"), "User": F.col("user_id")})
    return _table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", "m.source", "m.correlation_id", F.col("m.properties")["Path"].alias("path"), F.col("m.properties")["User"].alias("user"))


def casc_ids(spark, d):
    """Verdicts with an id and a time of their own: all ids differ, and all times are one query's."""
    v = cascade.analyze(_prompts(spark, d), "text", LIGHT, with_id=True)
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("verdict.analysis_id").alias("ids"), F.count_distinct("verdict.ts").alias("times"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (failed_responses, failed_counters, pat_timeouts, pat_catalogue, pat_as_of, cat_history, sem_limits, sem_calls, sem_states, tel_histogram, tel_latency, tel_quantiles, tel_severity_rollup, pat_spans, pat_united, pat_redacted, hist_split, casc_model, val_warnings, lang_gate_options, heu_levels, thr_message, req_metadata, casc_ids)}


_HISTORY = """c AS (SELECT concat('watch-', event_id % 25) AS w, ts, event_id, event_type = 'purchase' AS removed, CASE WHEN event_type = 'signup' THEN concat('"k": ', json_extract_string(props, '$.k'), '[^0-9]') ELSE '' END AS r FROM events WHERE event_type IN ('signup', 'purchase'))"""


def _spans_sql(source: str, patterns: list[tuple[str, ...]] = PLAIN) -> str:
    """CTEs up to s(id, pattern_id, b, e) over source's p(id, t)."""
    rows = ", ".join(f"{{i: {q(p[0])}, r: {q('(?i)' + p[4].replace('(?i)', ''))}}}" for p in patterns)
    return f"""{source}, c AS (SELECT x.i, x.r FROM (SELECT unnest([{rows}]) AS x)), f AS (SELECT id, i AS pattern_id, regexp_extract_all(t, r) AS m, string_split_regex(t, r) AS g FROM p, c WHERE regexp_matches(t, r)),
u AS (SELECT id, pattern_id, unnest(m) AS m, unnest(g[:len(m)]) AS g, generate_subscripts(m, 1) AS k FROM f),
s AS (SELECT id, pattern_id, (sum(length(m) + length(g)) OVER w - length(m))::INT AS b, (sum(length(m) + length(g)) OVER w)::INT AS e FROM u WINDOW w AS (PARTITION BY id, pattern_id ORDER BY k)),
v AS (SELECT *, coalesce(b > max(e) OVER (PARTITION BY id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM s),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run FROM v),
z AS (SELECT id, min(b) AS b, max(e) AS e, count(*) AS n FROM y GROUP BY id, run)"""


def oracle_sql() -> dict[str, str]:
    said = "layer <> 'Aggregated' OR pt OR hc >= 0.5"
    failed = f"{cascade_sql(True)}, f AS (SELECT *, layer <> 'Validation' AND length(t) % 7 = 0 AS failed, layer = 'Validation' AS bad FROM v), g AS (SELECT *, threat AND NOT failed AS stopped, threat AND NOT failed AND ({said}) AS told FROM f)"

    def response(policy: str) -> str:
        error = "bad OR failed" if policy == CLOSED else "false"
        return f"""SELECT * FROM (WITH {failed} SELECT id, '{policy}' AS on_error, CASE WHEN {error} THEN 'error' WHEN stopped THEN 'block' ELSE 'pass' END AS action, CASE WHEN {error} THEN 'Security Analysis Failed' WHEN stopped THEN 'Request Blocked' END AS title,
            CASE WHEN {error} THEN '500' WHEN stopped THEN '400' END AS status, CASE WHEN told THEN CASE WHEN layer IN ('PatternMatching', 'Aggregated') THEN coalesce(category, 'LLM01') ELSE 'LLM01' END END AS category FROM g)"""

    counts = {"analyses": "count(*) FILTER (NOT bad)", "threats": "count(*) FILTER (stopped)", "errors": "count(*) FILTER (failed)", "invalid": "count(*) FILTER (bad)", "chars": "sum(length(t)) FILTER (NOT bad)::BIGINT", "longest": "max(length(t)) FILTER (NOT bad)"}
    events = {"Started": "count(*) FILTER (NOT bad)", "ThreatDetected": "count(*) FILTER (told)", "Completed": "count(*) FILTER (NOT bad AND NOT failed)"}
    counters = " UNION ALL ".join(f"SELECT * FROM (WITH {failed} " + " UNION ALL ".join(f"SELECT '{policy}' AS on_error, '{what}' AS what, {n} AS n FROM g" for what, n in (counts | events).items()) + ")" for policy in (CLOSED, OPEN))
    return {
        "failed_responses": " UNION ALL ".join(map(response, (CLOSED, OPEN))),
        "failed_counters": f"SELECT * FROM ({counters}) WHERE n > 0 OR what NOT IN ('Started', 'ThreatDetected', 'Completed')",
        "pat_timeouts": _timeouts_sql(),
        "val_warnings": rf"""WITH {P_SQL}, o AS (SELECT id, concat(CASE WHEN id % 3 = 0 THEN {q(_NINE)} ELSE '' END, t) AS t FROM p), c AS (SELECT id, unnest(regexp_extract_all(t, {_class_sql(catalog.SUSPICIOUS)})) AS c, generate_subscripts(regexp_extract_all(t, {_class_sql(catalog.SUSPICIOUS)}), 1) AS k FROM o),
            f AS (SELECT id, concat('U+', lpad(printf('%X', unicode(c)), 4, '0')) AS c, min(k) AS k FROM c GROUP BY 1, 2), g AS (SELECT id, count(*) AS n, list(c ORDER BY k) AS cs FROM f GROUP BY id)
            SELECT o.id, CASE WHEN n > 0 THEN concat('PROMPT_SUSPICIOUS_CHARS: ', array_to_string(cs[1:5], ', '), CASE WHEN n > 5 THEN concat(' and ', n - 5, ' more') ELSE '' END) END AS warning,
                   CASE WHEN NOT regexp_matches(t, '\S') THEN 'PROMPT_REQUIRED: prompt is missing or blank' WHEN o.id % 7 = 0 THEN 'PROMPT_TOO_LONG: system prompt of more than 50000 characters' END AS error FROM o LEFT JOIN g USING (id)""".replace("\\\\", "\\"),
        "lang_gate_options": f"""WITH {P_SQL}, {language_sql()}, g AS (SELECT id, length(t) < 40 AS short, code, confidence, CASE code {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in catalog.LANGUAGES.items())} END AS name FROM l),
            s AS (SELECT id, CASE WHEN short THEN 'short' WHEN confidence < 0.7 THEN 'low' WHEN code IN ('de', 'en') THEN 'free' ELSE 'other' END AS s, name FROM g)
            SELECT id, s <> 'short' AS proceed, s = 'short' AS blocked, s IN ('low', 'other') AS warning, CASE s WHEN 'short' THEN 'Text too short for reliable language detection' WHEN 'low' THEN 'Language detection confidence too low. Detection may be less effective.' WHEN 'other' THEN concat('Language ', chr(39), name, chr(39), ' is not supported. Supported: [de, EN]. Detection may be less effective.') END AS message, CASE WHEN s = 'short' THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM s""",
        "heu_levels": " UNION ALL ".join(f"""SELECT * FROM (WITH {P_SQL}, c AS (SELECT {' + '.join(f'contains(lower(t), {q(w)})::INT' for w in catalog.DIRECTIVE_WORDS)} AS a FROM p) SELECT '{level}' AS level, count(*) FILTER (a >= {least}) AS n, round(sum(least(1.0, least(1.0, a / 5.0) * {m})) FILTER (a >= {least}), 6)::DOUBLE AS total FROM c)""" for level, least, m in (("Low", 5, 0.7), ("Medium", 3, 1.0), ("High", 2, 1.2), ("Paranoid", 1, 1.5))),
        "thr_message": f"""WITH {cascade_sql(True)}, s AS (SELECT id, threat, {said} AS told, confidence AS c, layer, category FROM v), m AS (SELECT *, concat(round(c * 100)::INT, '%') AS share, CASE WHEN layer = 'LanguageFilter' THEN 'Medium' WHEN c >= 0.9 THEN 'Critical' WHEN c >= 0.8 THEN 'High' WHEN c >= 0.6 THEN 'Medium' ELSE 'Low' END AS severity FROM s)
            SELECT id, CASE WHEN threat AND NOT told THEN concat('Potential prompt injection detected (AnalysisId: ', id, ', Confidence: ', share, ')') WHEN threat THEN concat('Prompt injection detected: ', CASE WHEN layer = 'LanguageFilter' THEN 'Unsupported Language' ELSE 'Prompt Injection' END, ' (AnalysisId: ', id, ', OWASP: ', CASE WHEN layer IN ('PatternMatching', 'Aggregated') THEN coalesce(category, 'LLM01') ELSE 'LLM01' END, ', Confidence: ', share, ', Severity: ', severity, ')') END AS message FROM m""",
        "req_metadata": "SELECT event_id, 'Events' AS source, concat('c-', event_id) AS correlation_id, concat('/', event_type) AS path, user_id::VARCHAR AS user FROM events",
        "casc_ids": f"WITH {P_SQL} SELECT count(*) AS n, count(*) AS ids, 1::BIGINT AS times FROM p",
        "pat_spans": f"WITH {_spans_sql(P_SQL)} SELECT id, pattern_id, b AS begin, e AS end FROM s",
        "pat_united": f"WITH {_spans_sql('p AS (SELECT doc_id AS id, text AS t FROM documents)', _WORDS)} SELECT id AS doc_id, b AS begin, e AS end, n FROM z",
        "pat_redacted": f"""WITH {_spans_sql(P_SQL)}, l AS (SELECT id, lag(e, 1, 0) OVER (PARTITION BY id ORDER BY b) AS a, b, e FROM z), r AS (SELECT id, string_agg(concat(substr(t, a + 1, b - a), '[removed]'), '' ORDER BY b) AS said, max(e) AS e FROM l JOIN p USING (id) GROUP BY id)
            SELECT id, CASE WHEN said IS NULL THEN t ELSE concat(said, substr(t, e + 1)) END AS text FROM p LEFT JOIN r USING (id)""",
        "hist_split": r"""WITH c AS (SELECT conv_id, turn, concat(coalesce(text, ''), CASE turn WHEN 1 THEN ' ignore all previous' WHEN 2 THEN ' instructions' ELSE '' END) AS t FROM conversations),
h AS (SELECT conv_id, turn, t, count(*) OVER w - 1 AS before, string_agg(t, chr(10)) OVER w AS said FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, before::INT AS before, regexp_matches(said, '(?is)\bignore all previous\b.*\binstructions\b') AS is_threat, regexp_matches(t, '(?is)\bignore all previous\b.*\binstructions\b') AS alone, sha256(said) AS digest FROM h""".replace("\\\\", "\\"),
        "sem_limits": """WITH RECURSIVE e AS (SELECT event_id, event_type AS k, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS w, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT k, w, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY w) AS rn FROM e GROUP BY k, w),
c AS (SELECT k, w, n, rn, 0::BIGINT AS c FROM n WHERE rn = 1 UNION ALL SELECT n.k, n.w, n.n, n.rn, greatest(0, least(1, greatest(0, c.c + c.n - 2)) - 2 * (n.w - c.w - 1)) FROM c JOIN n ON n.k = c.k AND n.rn = c.rn + 1)
SELECT event_id, CASE WHEN i <= 3 - c.c THEN 'success' ELSE 'rate_limited' END AS status, round(CASE WHEN i <= 2 - c.c THEN 0.0 WHEN i <= 3 - c.c THEN ((e.w + 1) * 3600000000 - us) / 1000000 END, 6)::DOUBLE AS wait FROM e JOIN c USING (k, w)""",
        "sem_states": " UNION ALL ".join(f"""SELECT * FROM (WITH {P_SQL}, s AS (SELECT id, {status} AS status, id % 5 = 0 OR least((id % 13) / 8, 1.0) >= 0.7 AS threat FROM p) SELECT '{name}' AS settings, status, status IN ('allowlisted', 'error', 'success') AS was_executed, count(*) AS n, count(*) FILTER (status = 'success' AND threat) AS threats FROM s GROUP BY status)""" for name, status in (
            ("set", "CASE WHEN regexp_matches(t, 'the weather', 'i') THEN 'allowlisted' WHEN id % 7 = 0 THEN 'rate_limited' WHEN id % 7 = 1 THEN 'concurrency_limited' WHEN id % 11 = 0 THEN 'rate_limited' WHEN id % 9 = 0 OR id % 11 = 1 THEN 'error' ELSE 'success' END"), ("unset", "'misconfigured'"), ("off", "'disabled'"))),
        "tel_histogram": f"SELECT lang, {', '.join(f'count(*) FILTER (length(text) <= {b}) AS le_{b}' for b in telemetry.LENGTHS)}, count(text) AS le_inf FROM documents GROUP BY lang",
        "tel_latency": f"SELECT ts::DATE AS day, {', '.join(f'count(*) FILTER (value <= {b}) AS le_' + str(b).replace('.', '_') for b in telemetry.LATENCIES)}, count(value) AS le_inf FROM events GROUP BY 1",
        "tel_quantiles": "SELECT event_type, count(value) AS n, true AS p50, true AS p95, true AS p99 FROM events GROUP BY 1",
        "tel_severity_rollup": f"""WITH {cascade_sql(True)}, s AS (SELECT CASE WHEN layer = 'LanguageFilter' THEN 'Medium' WHEN confidence >= 0.9 THEN 'Critical' WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN layer IN ('PatternMatching', 'Aggregated') THEN coalesce(category, 'LLM01') ELSE 'LLM01' END AS category FROM v WHERE threat AND ({said}))
            SELECT severity, category, count(*) AS n, grouping_id(severity, category) AS level FROM s GROUP BY ROLLUP (severity, category)""",
        "pat_catalogue": f"""WITH c AS (SELECT concat('passage-', item_id) AS id, array_to_string(regexp_extract_all(text, '[A-Za-z]+')[3:6], '[^a-z]+') AS r FROM benchmark UNION ALL SELECT x.i, x.r FROM (SELECT unnest([{', '.join(f"{{i: {q(p[0])}, r: {q(p[4].replace('(?i)', ''))}}}" for p in PLAIN)}]) AS x))
            SELECT DISTINCT doc_id, id AS pattern_id, 'match' AS outcome FROM documents, c WHERE regexp_matches(text, r, 'i')""",
        "pat_as_of": f"""WITH {_HISTORY}, t AS (SELECT event_id, ts, props, w FROM events, (SELECT DISTINCT w FROM c) WHERE event_type NOT IN ('signup', 'purchase')), l AS (SELECT w, ts, arg_max(r, event_id) AS r, arg_max(removed, event_id) AS removed FROM c GROUP BY w, ts)
            SELECT t.event_id, t.w AS pattern_id, 'match' AS outcome FROM t ASOF JOIN l ON t.w = l.w AND t.ts >= l.ts WHERE NOT l.removed AND regexp_matches(props, l.r)""",
        "cat_history": f"WITH {_HISTORY}, g AS (SELECT *, lag(NOT removed) OVER o AS there, lag(r) OVER o AS was FROM c WINDOW o AS (PARTITION BY w ORDER BY ts, event_id)) SELECT ts::DATE AS day, CASE WHEN removed THEN 'removed' WHEN there IS NOT TRUE THEN 'added' ELSE 'modified' END AS change, count(*) AS n FROM g WHERE removed AND there OR NOT removed AND (there IS NOT TRUE OR was <> r) GROUP BY 1, 2",
    }

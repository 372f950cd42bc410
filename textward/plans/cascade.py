"""The cascade: language gate, patterns, heuristics, scoring, aggregation. Each step is a projection, so there is no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward import catalog
from textward.config import OPEN, Config
from textward.functions import tokenize
from textward.functions.features import char_features, features
from textward.functions.text import clamp, let, percent, severity_of
from textward.operators import heuristics, language, ml, patterns, validate
from textward.shipping import ship

ANALYSIS = ["validation", "language", "patterns", "heuristics", "ml", "verdict"]


def analyze(df: DataFrame, text: str = "text", config: Config | None = None, more_patterns: Sequence[patterns.Pattern] = (), analyzers: Sequence[Callable[[Column], Column]] = (), detector: Callable[[Column], Column] | None = None, model: Column | Callable[[Column, Column], Column] | None = None, system_prompt: str | None = None, with_id: bool = False) -> DataFrame:
    """df with the layers' structs and `verdict`. Columns of df with those names are replaced. Invalid texts get a verdict with
    status invalid, whatever is to happen on errors. A text for which `detector` gives null has failed: its status is error, or
    fail_open where errors are to fail open. An analyzer that gives null is left out of the mean. `model` is a column of
    probabilities, or a function from token ids and mask to one, as ml.model_udf() gives; ids are made, and the model runs, only for texts
    that reach scoring. Where it gives null the features alone decide, in mode Degraded. Without config.include_breakdown, rows that no single layer decided have no layers'
    structs."""
    config = config or Config()
    taken = set(ANALYSIS) | {"_text", "_open", "_repeated", "_chars", "_facts", "_found", "_failed", "_ids", "_model"}
    kept = [c for c in df.columns if c not in taken or c == text]
    t = F.col("_text")
    rows = patterns.active(config, more_patterns)
    out = df.select(*kept, F.col(text).alias("_text"), validate.validation(F.col(text), config, F.col(system_prompt) if system_prompt else None).alias("validation"))
    failed = F.lit(False)
    if detector is not None and config.language.enabled:
        out = out.withColumn("_found", detector(t))
        failed = F.col("validation.is_valid") & F.col("_found").isNull()
        out = out.withColumn("language", language.gate(t, F.coalesce(F.col("_found"), language.detect(F.lit(""))), config))
    else:
        out = out.withColumn("language", language.gate(t, language.detect(t), config))
    out = out.withColumn("_failed", failed)
    # later layers see only the texts that reach them
    open_gate = F.col("validation.is_valid") & ~F.col("_failed") & ~F.col("language.blocked")
    out = out.withColumn("_open", F.when(open_gate, t))
    repeated = None
    if config.patterns.enabled and any(r[0] == catalog.REPETITION for r in rows):
        out, repeated = patterns.with_repetition(out, "_open", "_repeated"), F.col("_repeated")
    out = out.withColumn("patterns", F.when(open_gate, patterns.layer(F.col("_open"), config, rows, repeated)))
    exit1 = F.coalesce(F.col("patterns.is_threat") & (F.col("patterns.confidence") >= config.patterns.early_exit), F.lit(False))
    out = out.withColumn("heuristics", F.when(open_gate & ~exit1, heuristics.layer(t, config, analyzers, F.col("patterns.timeout_count"))))
    p, h = F.coalesce("patterns.confidence", F.lit(0.0)), F.coalesce("heuristics.confidence", F.lit(0.0))
    exit2 = F.coalesce(F.col("heuristics.is_definitive"), F.lit(False))
    if config.ml.enabled:
        scored = open_gate & ~exit1 & ~exit2 & ((p + h) / 2 >= config.ml.threshold * 0.5)
        ship(df.sparkSession)
        out = out.withColumn("_chars", char_features()(F.when(scored, t)))
        failed_model = None
        if callable(model) and not isinstance(model, Column):
            out = out.withColumn("_ids", F.when(scored, tokenize.word_ids(t, config.ml.max_sequence)))
            out = out.withColumn("_model", model(F.col("_ids"), F.when(F.col("_ids").isNotNull(), tokenize.attention_mask(F.col("_ids")))))
            model, failed_model = F.col("_model"), F.col("_model").isNull()
        out = out.withColumn("ml", F.when(scored, ml.layer(t, features(t, F.col("_chars")), config, model, failed_model)))
    else:
        out = out.withColumn("ml", F.lit(None).cast("struct<layer:string,was_executed:boolean,status:string,confidence:double,is_threat:boolean,mode:string,threshold:double,threat_probability:double,safe_probability:double,top_features:array<string>,disabled_features_count:int>"))
    out = out.withColumn("_facts", _facts(config)).withColumn("verdict", verdict(config, with_id))
    if not config.include_breakdown:
        told = F.col("verdict.decision_layer") != "Aggregated"
        return out.select(*kept, "validation", *[F.when(told, F.col(c)).alias(c) for c in ANALYSIS[1:-1]], "verdict")
    return out.select(*kept, *ANALYSIS)


def _facts(config: Config) -> Column:
    """What the verdict follows from: each layer's flag and confidence, the exits and the weighted mean. Bound step by step, so that
    each value is in the plan once."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w = config.aggregation
    base = F.struct(
        F.col("validation.is_valid").alias("valid"), F.col("_failed").alias("failed"), F.col("language.blocked").alias("blocked"), F.col("language.confidence").alias("lc"), flag("patterns.is_threat").alias("pt"), zero("patterns.confidence").alias("pc"),
        flag("heuristics.is_threat").alias("ht"), zero("heuristics.confidence").alias("hc"), flag("heuristics.is_definitive").alias("exit2"), flag("heuristics.was_executed").alias("h_ran"),
        flag("ml.is_threat").alias("mt"), zero("ml.confidence").alias("mc"), flag("ml.was_executed").alias("m_ran"),
    )

    def mean(x: Column) -> Column:
        weight = F.lit(w.patterns) + F.when(x["h_ran"], w.heuristics).otherwise(0.0) + F.when(x["m_ran"], w.ml).otherwise(0.0)
        total = let(weight, lambda n: x["pc"] * w.patterns / n + F.when(x["h_ran"], x["hc"] * w.heuristics / n).otherwise(0.0) + F.when(x["m_ran"], x["mc"] * w.ml / n).otherwise(0.0))
        exit1 = x["pt"] & (x["pc"] >= config.patterns.early_exit)
        exit3 = x["m_ran"] & x["mt"] & (x["mc"] >= config.ml.threshold)
        layer = F.when(~x["valid"], "Validation").when(x["failed"], "FailOpen" if config.on_error == OPEN else "Error").when(x["blocked"], "LanguageFilter").when(exit1, "PatternMatching").when(x["exit2"], "Heuristics").when(exit3, "MLClassification").otherwise("Aggregated")
        return F.struct(x.alias("x"), clamp(total).alias("mean"), layer.alias("layer"))

    def decide(y: Column) -> Column:
        x, at = y["x"], lambda name: y["layer"] == name
        threat = F.when(at("LanguageFilter"), F.lit(True)).when(at("PatternMatching"), x["pt"]).when(at("Heuristics"), x["ht"]).when(at("MLClassification"), x["mt"]).when(at("Aggregated"), y["mean"] >= config.threat_threshold).otherwise(F.lit(False))
        # a layer that decides that a text is safe leaves no confidence
        confidence = F.when(at("LanguageFilter"), x["lc"]).when(at("PatternMatching"), x["pc"]).when(at("Heuristics"), F.when(x["ht"], x["hc"]).otherwise(0.0)).when(at("MLClassification"), x["mc"]).when(at("Aggregated"), y["mean"]).otherwise(0.0)
        return F.struct(x.alias("x"), y["layer"].alias("layer"), threat.alias("threat"), confidence.alias("confidence"))

    return let(let(base, mean), decide)


def verdict(config: Config, with_id: bool = False) -> Column:
    """The verdict's struct from the layers' columns and _facts()."""
    names = ", ".join(config.language.supported)
    at = lambda name: F.col("_facts.layer") == name
    threat, confidence = F.col("_facts.threat"), F.col("_facts.confidence")
    decided = F.col("_facts.layer")
    blocked = at("LanguageFilter")
    sources = F.array_compact(F.array(F.when(F.col("_facts.x.pt"), "PatternMatching"), F.when(F.col("_facts.x.ht"), "Heuristics"), F.when(F.col("_facts.x.mt"), "MLClassification")))
    share = percent(confidence)
    explanation = F.when(blocked, F.concat(F.lit("Input language '"), F.col("language.name"), F.lit(f"' is not supported. Supported languages: [{names}]."))).when(at("Aggregated"), F.concat(F.lit("Potential prompt injection detected with confidence "), share, F.lit(". Detected by: "), F.array_join(sources, ", "), F.lit("."))).otherwise(F.concat(F.lit("Threat detected by "), decided, F.lit(" layer with "), share, F.lit(" confidence.")))
    by_pattern = at("PatternMatching") | at("Aggregated")
    matched = F.when(by_pattern & (F.size("patterns.matched") > 0), F.col("patterns.matched"))
    # a single layer that carries data counts as a pattern source, and names itself too
    told = F.when(blocked, F.array(F.lit("LanguageFilter"))).when(at("Aggregated"), sources).otherwise(F.array(F.lit("PatternMatching"), decided))
    info = F.struct(
        F.coalesce(F.when(by_pattern, F.col("patterns.category")), F.lit(catalog.THREAT_CATEGORY)).alias("owasp_category"), F.when(blocked, "Unsupported Language").otherwise(catalog.THREAT_TYPE).alias("threat_type"), explanation.alias("explanation"),
        F.when(blocked, f"Please submit your request in a supported language ({names}).").otherwise(catalog.USER_MESSAGE).alias("user_facing_message"), F.when(blocked, "Medium").otherwise(severity_of(confidence)).alias("severity"), told.alias("detection_sources"), matched.alias("matched_patterns"),
    )
    broken = F.col("_facts.x.failed") & ~at("Validation")
    valid, free = ~at("Validation") & ~broken, ~at("Validation") & ~broken & ~blocked
    executed = F.array_compact(F.array(F.when(valid & F.col("language.was_executed"), "LanguageFilter"), F.when(free, "PatternMatching"), F.when(free & ~at("PatternMatching"), "Heuristics"), F.when(F.col("_facts.x.m_ran"), "MLClassification")))
    status = F.when(valid, "analyzed").when(broken, "fail_open" if config.on_error == OPEN else "error").otherwise("invalid")
    some = threat & (~at("Aggregated") | (F.size(sources) > 0))
    fields = [threat.alias("is_threat"), confidence.alias("confidence"), decided.alias("decision_layer"), executed.alias("executed_layers"), F.when(some, info).alias("threat_info"), status.alias("status")]
    if with_id:
        fields += [F.uuid().alias("analysis_id"), F.current_timestamp().alias("ts")]
    return F.struct(*fields)


def settled(analyzed: DataFrame) -> DataFrame:
    """The same rows with `_row`, a number that keeps filters from being pushed into the projections above: a pushed filter would
    repeat the cascade. The filter has to name `_row`; only() does."""
    return analyzed.withColumn("_row", F.monotonically_increasing_id())


def only(analyzed: DataFrame, condition: Column) -> DataFrame:
    """Rows of analyze()'s output that meet a condition on it, with the cascade computed once."""
    return settled(analyzed).where((F.col("_row") >= 0) & condition).drop("_row")


def sided(df: DataFrame, text: str = "text", config: Config | None = None, **parts) -> DataFrame:
    """analyze() with `side`: pass or block. Written with partitionBy("side"), both sides come from one run of the cascade."""
    passes = ~F.col("verdict.is_threat") & F.col("verdict.status").isin("analyzed", "fail_open")
    return analyze(df, text, config, **parts).withColumn("side", F.when(passes, "pass").otherwise("block"))


def guard(df: DataFrame, text: str = "text", config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and those that are blocked, both with their analysis. Each is a query that runs the cascade; sided()
    serves both with one."""
    found = sided(df, text, config)
    return only(found, F.col("side") == "pass").drop("side"), only(found, F.col("side") == "block").drop("side")

"""Experiments with rules that add candidates sharing a single address token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import similarity as s
from tributary.functions import text as t
from tributary.functions.similarity import safe_ratio
from tributary.operators import blocking
from tributary.operators import classify as c
from tributary.operators.blocking import PAIR, SPAN, single_token_pairs, times
from tributary.operators.features import joined
from tributary.operators.stats import distribution, percentile
from tributary.sources.tsv import source_of

# The limits of the rules, their similarities, and the frequencies of the what-if report.
RULE_F_LIMIT, RULE_3_SIMILARITY, LEAST_SIMILARITY = 5_000, 0.80, 0.60
#: Rule name to the frequency limit of the shared token; no limit is None. Rule A adds nothing.
LIMITS: dict[str, int | None] = {"C": 100, "D": 500, "E": 1_000, "F": 5_000, "B": None}
RARITY = (10, 50, 100, 500, 1_000, 5_000)


NAMED, NARROW, WIDE, TRUE = range(4)


def _sized(classes: int):
    """Per record and bucket: candidates now, and single-token pairs of each class that they lack; of each, how many are true."""

    def count(rows: pa.Table, new: np.ndarray, ids: pa.DictionaryArray) -> pa.RecordBatch:
        code, row = blocking.codes(rows, new)
        kind, level = rows["kind"].to_numpy()[row], rows["level"].to_numpy()[row]
        cell, known, at = np.unique(code, return_index=True, return_inverse=True)
        n, copies = len(cell), rows["copies"].combine_chunks().flatten().to_numpy()[known]
        has = lambda k: np.bincount(at[kind == k], minlength=n)
        token = (kind == NARROW) | (kind == WIDE)
        once = np.unique(row[token] * n + at[token])  # a token counts once, however often a target has it
        shared = np.bincount(once % n, minlength=n) if n else np.zeros(0, np.int64)
        level_of = np.zeros(n, np.int64)
        level_of[at[token]] = level[token]
        current = (has(NAMED) > 0) | (has(WIDE) >= 2)
        which = np.where(current, 0, np.where(shared == 1, level_of, -1))
        first = np.flatnonzero(new)
        group, true, most = cell // SPAN, has(TRUE) > 0, len(first) * (classes + 1)
        counts = [np.bincount((group * (classes + 1) + which)[keep], copies[keep], most).reshape(-1, classes + 1) for keep in (which >= 0, (which >= 0) & true)]
        columns = [ids.dictionary.take(pa.array(ids.indices.to_numpy()[first]))]
        columns += [pa.array(c[:, k].astype(np.int64)) for c in counts for k in range(classes + 1)]
        return pa.RecordBatch.from_arrays(columns, ["s1_id", *(f"{x}{k}" for x in "nh" for k in range(classes + 1))])

    return blocking.by_record(count)


def class_counts(s1: DataFrame, targets: DataFrame, truth: DataFrame, frequency: DataFrame, limits: list[int | None]) -> DataFrame:
    """(s1_id, n0.., h0..): of each S1 record, the candidates (0) and what each limit adds to the one before; and those that are true.

    Names, names' tokens and addresses' tokens are one packed index; a record's arrays are put together place by place, so no pair
    is ever a row. A target counts as often as its ``copies`` say.
    """
    named = F.when(F.col("name") != "", F.array(F.concat(F.lit("e:"), "name"))).otherwise(F.array().cast("array<string>"))
    marked = lambda mark, tokens: F.transform(tokens, lambda x: F.concat(F.lit(mark), x))
    index = blocking.TokenIndex.of(targets.withColumn("_t", F.concat(named, marked("n:", "name_set"), marked("a:", "address_tokens"))), "_t", copies=True)
    level = F.lit(len(limits))
    for k in reversed(range(len(limits))):
        level = F.when(F.lit(True) if limits[k] is None else F.col("frequency") <= limits[k], F.lit(k + 1)).otherwise(level)
    known = frequency.select(F.concat(F.lit("a:"), "token").alias("token"), level.cast("byte").alias("level"))
    names = blocking.postings(s1.withColumn("_t", F.concat(named, marked("n:", "name_set"))), "_t", "s1_id").withColumn("kind", F.lit(NAMED))
    wide = F.when(F.size("address_set") >= 2, WIDE).otherwise(NARROW)
    places = s1.select("country_key", F.explode(marked("a:", "address_set")).alias("token"), F.col("entity_id").alias("s1_id"), wide.alias("kind"))
    probes = names.union(places).join(known, "token", "left").select("s1_id", "country_key", "token", F.col("kind").cast("byte").alias("kind"), F.coalesce("level", F.lit(0)).cast("byte").alias("level"))
    true = truth.select(*PAIR).distinct().join(index.numbers, "candidate_id").groupBy("s1_id", "bucket").agg(F.collect_list(F.struct("place", "copies")).alias("x")).select("s1_id", "bucket", F.col("x.place").alias("places"), F.col("x.copies").alias("copies"))
    met = blocking.dealt(probes, index).unionByName(true.withColumns({"kind": F.lit(TRUE).cast("byte"), "level": F.lit(0).cast("byte")}))
    columns = [f"{x}{k}" for x in "nh" for k in range(len(limits) + 1)]
    counted = met.repartition("s1_id", "bucket").sortWithinPartitions("s1_id", "bucket").mapInArrow(_sized(len(limits)), "s1_id string, " + ", ".join(f"{c} long" for c in columns))
    return counted.groupBy("s1_id").agg(*[F.sum(c).alias(c) for c in columns])


def rule_sizes(s1: DataFrame, targets: DataFrame, truth: DataFrame, frequency: DataFrame, limits: dict[str, int | None] = LIMITS) -> DataFrame:
    """One row per rule A-F: true pairs recovered and missed, entities affected, candidate counts per entity.

    Rules are counted together, each limit over the one before; no pairs are made. Sizes are over all S1 records, each as
    often as its ``copies`` say.
    """
    order = sorted(limits, key=lambda k: (limits[k] is None, limits[k] or 0))
    sums = class_counts(s1, targets, truth, frequency, [limits[k] for k in order])
    upto = lambda x, k: sum((F.col(f"{x}{i}") for i in range(1, k + 1)), F.col(f"{x}0"))
    ids = s1.select(F.col("entity_id").alias("s1_id"), times(s1).alias("k"))
    each = [F.struct("k", F.lit(r).alias("rule"), upto("n", k).alias("n"), upto("h", k).alias("h"), (upto("n", k) - F.col("n0")).alias("x")) for k, r in enumerate(["A", *order])]
    rows = ids.join(sums, "s1_id", "left").na.fill(0).select(F.explode(F.array(*each)).alias("r")).select("r.*")
    found = rows.groupBy("rule").agg(
        F.sum(F.col("h") * F.col("k")).alias("recovered"),
        F.sum(F.when(F.col("x") > 0, F.col("k")).otherwise(0)).alias("affected"),
        F.sum(F.col("n") * F.col("k")).alias("candidates"),
        F.min("n").alias("min_size"),
        *[percentile("n", q, F.col("k")).alias(n) for q, n in ((0.5, "median_size"), (0.9, "p90_size"), (0.95, "p95_size"))],
        F.max("n").alias("max_size"),
    )
    total = truth.select(*PAIR, times(truth).alias("copies")).distinct().agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("true_pairs"))
    return found.crossJoin(F.broadcast(total)).withColumn("missed", F.col("true_pairs") - F.col("recovered")).drop("true_pairs")  # one row


def best_rule(sizes: DataFrame) -> DataFrame:
    """The rule that recovers most; of equal ones the one with the smaller median, then maximum, then name."""
    return sizes.orderBy(F.desc("recovered"), "median_size", "max_size", "rule").limit(1)


def additions(s1: DataFrame, targets: DataFrame, current: DataFrame, truth: DataFrame, frequency: DataFrame, limit: int | None = RULE_F_LIMIT) -> DataFrame:
    """What Rule F adds to the current candidates: pair, token, frequency, source, and whether it is true."""
    found = single_token_pairs(s1, targets, frequency, limit).join(current, PAIR, "left_anti")
    known = truth.select(*PAIR).distinct().withColumn("t", F.lit(True))
    return found.join(known, PAIR, "left").withColumn("is_true", F.coalesce("t", F.lit(False))).drop("t").withColumn("source", source_of(F.col("candidate_id")))


def impact(s1: DataFrame, added: DataFrame) -> DataFrame:
    """One row: entities with any addition, any true one, only false ones, both; of all S1 records."""
    per = added.groupBy("s1_id").agg(F.count_if("is_true").alias("true"), F.count_if(~F.col("is_true")).alias("false"))
    t_, f_ = F.col("true") > 0, F.col("false") > 0
    return per.agg(
        F.count("*").alias("any_new"), F.count_if(t_).alias("any_true"), F.count_if(f_ & ~t_).alias("only_false"), F.count_if(t_ & f_).alias("both")
    )


def by_source(added: DataFrame) -> DataFrame:
    return added.groupBy("source").agg(F.count("*").alias("added"), F.count_if("is_true").alias("true"), F.count_if(~F.col("is_true")).alias("false"))


def rare_token_what_if(truth: DataFrame, current: DataFrame, s1: DataFrame, targets: DataFrame, frequency: DataFrame, thresholds: tuple[int, ...] = RARITY) -> DataFrame:
    """Per threshold: missed true pairs that share a three-letter name token at most that frequent; an upper bound, as country is ignored."""
    every = truth.select(*PAIR, times(truth).alias("copies")).distinct()
    gone = every.join(current, PAIR, "left_anti")
    tokens = lambda side, key: side.select(F.col("entity_id").alias(key), F.explode(t.three_letter_tokens(F.col("name"))).alias("token"))
    common = gone.join(tokens(s1, "s1_id"), "s1_id").join(tokens(targets, "candidate_id"), ["candidate_id", "token"]).join(frequency, "token", "left")
    rarest = common.groupBy(*PAIR).agg(F.min(F.coalesce("frequency", F.lit(0))).alias("rarest"), F.max("copies").alias("copies"))
    known = every.join(current.select(*PAIR).distinct().withColumn("c", F.lit(1)), PAIR, "left")
    return _what_if(rarest, known.withColumn("is_current", F.col("c") == 1), thresholds)


def with_rare_tokens(targets: DataFrame, frequency: DataFrame) -> DataFrame:
    """Targets with ``rare``: their three-letter name tokens, each with its frequency."""
    tokens = targets.select("entity_id", F.explode(t.three_letter_tokens(F.col("name"))).alias("token")).join(frequency, "token", "left")
    rare = tokens.groupBy("entity_id").agg(F.collect_list(F.struct("token", F.coalesce("frequency", F.lit(0)).alias("frequency"))).alias("rare"))
    return targets.join(rare, "entity_id", "left")


def rare_token_what_if_of(pairs: DataFrame, thresholds: tuple[int, ...] = RARITY) -> DataFrame:
    """The same from true pairs with ``copies``, ``is_current``, and the targets' ``rare`` tokens: none is shuffled."""
    mine = t.three_letter_tokens(F.col("s1_name"))
    common = F.filter("target_rare", lambda x: F.array_contains(mine, x["token"]))
    rarest = F.when(~F.col("is_current"), F.array_min(F.transform(common, lambda x: x["frequency"])))
    pairs = pairs.select("copies", "is_current", rarest.alias("rarest"))
    return _what_if(pairs, pairs, thresholds)


def _what_if(rarest: DataFrame, known: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    none = lambda x: F.coalesce(x, F.lit(0))
    counts = rarest.agg(*[none(F.sum(F.when(F.col("rarest") <= n, F.col("copies")))).alias(f"r{n}") for n in thresholds])
    totals = known.agg(none(F.sum("copies")).alias("true_pairs"), none(F.sum(F.when(F.col("is_current"), F.col("copies")))).alias("recovered_now"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("threshold"), F.col(f"r{n}").alias("recovered")) for n in thresholds]))
    rows = counts.crossJoin(totals).select("true_pairs", "recovered_now", each.alias("x")).select("x.*", "true_pairs", "recovered_now")  # two single rows
    return rows.select(
        "threshold",
        "recovered",
        safe_ratio(F.col("recovered_now") + F.col("recovered"), F.col("true_pairs")).alias("estimated_recall"),
        (F.col("true_pairs") - F.col("recovered_now") - F.col("recovered")).alias("remaining"),
    )


def measured(added: DataFrame, s1: DataFrame, targets: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Additions with what the selective rules and the reports ask of both records.

    A name similarity below ``least`` may be a bound on it, also below; ``addressed`` adds the addresses' similarity.
    """
    rows = joined(added, s1, targets, c.RAW)
    name = lambda side: t.light_normal(side("business_name"))
    rows = rows.withColumns(
        {
            "name_similarity": s.character_similarity(name(c.s1), name(c.target), least),
            "exact_name": name(c.s1) == name(c.target),
            "containment": s.contains_either(name(c.s1), name(c.target)),
            "shared_name_tokens": s.shared(c.s1("name_set"), c.target("name_set")),
            "name_token_overlap": s.overlap_coefficient(c.s1("name_set"), c.target("name_set")),
            "name_length_difference": F.abs(F.length(name(c.s1)) - F.length(name(c.target))),
            "shared_numeric_tokens": s.shared(c.s1("number_set"), c.target("number_set")),
            "shared_address_tokens": s.shared(c.s1("address_set"), c.target("address_set")),
            "numeric_token": t.is_number(F.col("token")),
            "same_country": c.s1("country_key") == c.target("country_key"),
        }
    )
    return c.with_place(rows)


def addressed(rows: DataFrame) -> DataFrame:
    """Measured rows with the similarity of both addresses."""
    address = lambda side: t.light_normal(side("business_address"))
    return rows.withColumn("address_similarity", s.character_similarity(address(c.s1), address(c.target)))


def selective_rules() -> dict[str, Column]:
    similar, textual = F.col("name_similarity"), ~F.col("numeric_token")
    return {
        "RULE 1: similarity >= 0.60": similar >= 0.60,
        "RULE 2: similarity >= 0.70": similar >= 0.70,
        "RULE 3: similarity >= 0.80": similar >= 0.80,
        "RULE 4: name containment": F.col("containment"),
        "RULE 5: similarity >= 0.60 OR containment": (similar >= 0.60) | F.col("containment"),
        "RULE 6: textual token AND similarity >= 0.60": textual & (similar >= 0.60),
    }


def of(condition: Column) -> Column:
    """How many pairs meet a condition, each as often as its ``copies`` say."""
    return F.sum(F.when(condition, F.col("copies")).otherwise(0))


def _unpivoted(rows: DataFrame, conditions: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each condition that a row meets."""
    each = F.filter(F.array(*[F.when(k, F.lit(n)) for n, k in conditions.items()]), lambda x: x.isNotNull())
    return rows.select(*keep, F.explode(each).alias("condition"))


def selective_report(rows: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Per rule: added, true, false, precision, recall of Rule F's true pairs, entities affected and their sizes, and per source.

    Sizes are over entities with at least one addition. A rule that adds nothing has no row.
    """
    rows = rows.withColumns({n: times(rows, n) for n in ("copies", "s1_copies", "target_copies")})
    met = _unpivoted(rows, rules or selective_rules(), ["s1_id", "source", "is_true", "copies", "s1_copies", "target_copies"])
    true, false = F.col("is_true"), ~F.col("is_true")
    counts = [F.sum("copies").alias("added"), of(true).alias("true"), of(false).alias("false")]
    counts += [of((F.col("source") == k) & x).alias(f"{n}_{k.lower()}") for k in ("S2", "S3") for n, x in (("added", F.lit(True)), ("true", true), ("false", false))]
    sizes = met.groupBy("condition", "s1_id").agg(F.sum("target_copies").alias("n"), F.max("s1_copies").alias("k")).groupBy("condition")
    sizes = sizes.agg(F.sum("k").alias("affected"), percentile("n", 0.5, F.col("k")).alias("median"), percentile("n", 0.9, F.col("k")).alias("p90"), F.max("n").alias("max"))
    known = rows.agg(F.coalesce(of(true), F.lit(0)).alias("known"))
    out = met.groupBy("condition").agg(*counts).join(sizes, "condition").crossJoin(F.broadcast(known))  # one row
    return out.withColumn("precision", safe_ratio(F.col("true"), F.col("added"))).withColumn("recall", safe_ratio(F.col("true"), F.col("known"))).drop("known")


def rule3_rows(rows: DataFrame) -> DataFrame:
    """Additions that Rule 3 keeps, with the reason of the false ones."""
    return addressed(rows.filter(F.col("name_similarity") >= RULE_3_SIMILARITY)).withColumn("reason", c.collision_reason())


def rule3_conditions() -> dict[str, Column]:
    name, address, textual = F.col("name_similarity"), F.col("address_similarity"), ~F.col("numeric_token")
    return {
        "name similarity >= 0.85": name >= 0.85,
        "name similarity >= 0.90": name >= 0.90,
        "shared name token": F.col("shared_name_tokens") > 0,
        "name containment": F.col("containment"),
        "textual Rule-3 token": textual,
        "numeric Rule-3 token": F.col("numeric_token"),
        ">=2 shared numeric address tokens": F.col("shared_numeric_tokens") >= 2,
        "address similarity >= 0.60": address >= 0.60,
        "address similarity >= 0.70": address >= 0.70,
        "address similarity >= 0.80": address >= 0.80,
        "same country + name similarity >= 0.80": F.col("same_country") & (name >= 0.80),
        **{f"name similarity >= {x:.2f} AND textual token": (name >= x) & textual for x in (0.80, 0.85, 0.90)},
    }


def condition_report(rows: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Per condition, also one that nothing meets: retained, true, false, precision, true recall, false reduced."""
    conditions = conditions or rule3_conditions()
    true, false = F.col("is_true"), ~F.col("is_true")
    n = lambda x: F.coalesce(of(x), F.lit(0))
    sums = [x for i, k in enumerate(conditions.values()) for x in (n(k & true).alias(f"t{i}"), n(k & false).alias(f"f{i}"))]
    one = rows.withColumn("copies", times(rows)).agg(n(true).alias("T"), n(false).alias("N"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"t{i}").alias("true"), F.col(f"f{i}").alias("false")) for i, n in enumerate(conditions)]))
    out = one.select("T", "N", each.alias("x")).select("x.*", "T", "N").withColumn("retained", F.col("true") + F.col("false"))
    out = out.withColumn("precision", safe_ratio(F.col("true"), F.col("retained"))).withColumn("true_recall", safe_ratio(F.col("true"), F.col("T")))
    return out.withColumn("false_reduced", F.col("N") - F.col("false")).drop("T", "N")


def boolean_features(rows: DataFrame) -> DataFrame:
    """(condition, true, false): how many true and false additions have each yes-or-no feature."""
    features = {
        "exact normalized name": F.col("exact_name"),
        "name containment": F.col("containment"),
        "shared useful name token": F.col("shared_name_tokens") > 0,
        "numeric Rule-3 token": F.col("numeric_token"),
        "textual Rule-3 token": ~F.col("numeric_token"),
        "same country": F.col("same_country"),
        "same city": F.col("same_city"),
        "same state/region": F.col("same_state"),
    }
    return condition_report(rows, features).select("condition", "true", "false")


def numeric_features(rows: DataFrame) -> DataFrame:
    """Per feature and class: n, min, median, p90, max."""
    names = ("name_similarity", "name_token_overlap", "name_length_difference", "shared_numeric_tokens", "shared_address_tokens", "frequency", "address_similarity")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]))
    return distribution(rows.select("is_true", times(rows).alias("copies"), each.alias("x")).select("is_true", "copies", "x.*"), "value", "feature", "is_true", times=F.col("copies"))

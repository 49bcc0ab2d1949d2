"""Queries of contracts over rows with planted faults: every rule must name exactly the rows that break it."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions.hashing import odd_hash
from veriloom.operators import synthetic
from veriloom.plans.query import query
from veriloom.session import table

#: Every so many rows, the fault of a rule.
_STEPS = {"label": 11, "reason": 13, "audit": 17, "name": 19, "source": 23, "copied": 29, "twice": 31, "field": 37, "span": 41, "order": 43, "alike": 47}


def _side(i, fuel):
    """Name, description and decisive span of one side of pair i."""
    span = F.concat(F.lit("with "), F.col("p_type"), F.lit(" can "), i) if fuel else F.concat(F.lit("quite empty "), i)
    description = F.concat(F.lit("comes "), span, F.lit(" inside the big red box on the upper shelf here"))
    return F.struct(F.concat(F.lit("box "), i).alias("name"), description.alias("description"), span.alias("decisive_span"))


def _bundle(spark, sf_dir):
    """Pairs made of `part`, with reviews, audits, training cards and protected rows; faults by row number."""
    every = lambda fault: F.col("p_partkey") % _STEPS[fault] == 0
    i = F.col("p_partkey").cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat(F.lit("p"), i).alias("pair_id"))
    positive, negative = _side(i, True), _side(i, False)
    lost = lambda side: F.struct(side["name"].alias("name"), side["description"].alias("description"), F.lit("not in it").alias("decisive_span"))
    rows = rows.select(
        "*", F.when(every("span"), lost(positive)).otherwise(positive).alias("positive"), F.when(every("alike"), F.struct(positive["name"].alias("name"), positive["description"].alias("description"), positive["decisive_span"].alias("decisive_span"))).otherwise(negative).alias("negative"),
        F.concat(F.lit("b"), (F.col("p_partkey") % 5).cast("string")).alias("boundary"), F.concat(F.lit("f"), (F.col("p_partkey") % 40).cast("string")).alias("style_frame_id"),
        F.lit("slot").alias("changed_slot"), F.when(every("field"), "elsewhere").otherwise("description").alias("changed_field"), F.lit("frame").alias("invariant_fact_frame"), (F.col("p_partkey") % 2 == 0).alias("positive_first"),
    )
    columns = ["pair_id", "positive", "negative", "boundary", "style_frame_id", "changed_slot", "changed_field", "invariant_fact_frame", "positive_first"]
    pairs = rows.select(columns).union(rows.where(every("twice")).select(columns))
    swapped = odd_hash(F.col("pair_id"))
    first, second = F.when(swapped, F.col("negative")).otherwise(F.col("positive")), F.when(swapped, F.col("positive")).otherwise(F.col("negative"))
    label = F.when(swapped, 0).otherwise(1)
    reviews = rows.select(
        "pair_id", F.when(every("label"), 1 - label).otherwise(label).alias("label_a"), (1 - label).alias("label_b"), F.upper(first["description"]).alias("evidence_a"), second["description"].alias("evidence_b"),
        F.lit(True).alias("pair_usable"), F.when(every("reason"), "odd").otherwise("NONE").alias("reject_reason"),
    )
    audits = rows.select("pair_id", "boundary", "style_frame_id", F.lit(True).alias("pass"), F.create_map(F.lit("all"), ~every("audit")).alias("checks"))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("positive").alias("s")), F.struct(F.lit(0).alias("label"), F.col("negative").alias("s")))).alias("o")
    at = lambda label: F.when((label == 1) == F.col("positive_first"), 0).otherwise(1)
    cards = rows.select("*", sides).select(
        "pair_id", F.when(every("order"), 1 - at(F.col("o.label"))).otherwise(at(F.col("o.label"))).alias("pair_position"), F.col("o.label").alias("organizer_label"),
        F.when(every("name"), F.lit("other")).otherwise(F.col("o.s.name")).alias("name"), F.col("o.s.description").alias("description"), F.col("o.s.decisive_span").alias("decisive_span"), F.lit(True).alias("fully_synthetic"),
        F.when(every("source"), F.lit(77)).cast("long").alias("source_id"), F.lit(None).cast("string").alias("source_component"),
    )
    protected = rows.where(every("copied")).select("positive.name", F.upper("positive.description").alias("description"))
    return pairs, reviews, audits, cards, protected


def _when(fault: str, *rules: str) -> str:
    return ", ".join(f"CASE WHEN i % {_STEPS[fault]} = 0 THEN '{r}' END" for r in rules)


# Closed form of the faults above. A pair that comes twice, or whose sides are alike, has its surfaces more than once.
_CONTRACT = f"""WITH r AS (SELECT p_partkey AS i, 'p' || p_partkey::VARCHAR AS pair_id FROM part), p AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE i % {_STEPS["twice"]} = 0)
SELECT pair_id, 'b' || (i % 5)::VARCHAR || '::f' || (i % 40)::VARCHAR AS sampling_frame, array_to_string(list_sort(list_distinct(list_filter([{", ".join((
    _when("label", "blind_direction"), _when("reason", "usability_stated"), _when("audit", "audit_passed"), _when("name", "cards_agree"), _when("source", "cards_synthetic"), _when("copied", "no_exact_copy", "no_shared_span"),
    _when("twice", "unique_id", "surfaces_unique"), _when("field", "changed_field_known"), _when("span", "spans_bound"), _when("order", "cards_in_order"), _when("alike", "sides_differ", "surfaces_unique"),
))}], lambda x: x IS NOT NULL))), ',') AS violations FROM p"""


@query(_CONTRACT)
def synthetic_pair_contract(spark, sf_dir):
    checked = synthetic.check_pairs(*_bundle(spark, sf_dir))
    return checked.select("pair_id", "sampling_frame", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query("WITH r AS (SELECT 'p' || p_partkey::VARCHAR AS pair_id, p_partkey AS i FROM part) SELECT pair_id FROM r WHERE i % 7 = 0 OR i % 9 = 0 OR i % 10 = 0")
def synthetic_roster(spark, sf_dir):
    """Pair ids that a review, an audit or the cards lack."""
    pairs, reviews, audits, cards, _ = _bundle(spark, sf_dir)
    number = F.substring("pair_id", 2, 20).cast("long")
    return synthetic.roster_mismatch(pairs, reviews.where(number % 7 != 0), audits.where(number % 9 != 0), cards.where(number % 10 != 0))

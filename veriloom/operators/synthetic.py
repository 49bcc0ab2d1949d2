"""The contract of synthetic contrast pairs with their reviews, audits and training cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.hashing import odd_hash
from veriloom.functions.text import audit_text, collapse, contract_tokens, padded_ngrams, spaced_words, surface_key, token_ngrams
from veriloom.operators import similarity
from veriloom.operators.contracts import ContractError
from veriloom.operators.pairs import violations
from veriloom.operators.policy import passes
from veriloom.operators.ranking import medians
from veriloom.session import materialised

_FIELDS = ("name", "description", "decisive_span")


def _surfaces(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, surface): both sides of every pair, as compared with other texts."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), surface_key(F.col(f"{s}.name"), F.col(f"{s}.description")).alias("surface")) for s in ("positive", "negative")]))
    return pairs.select("pair_id", sides.alias("s")).select("pair_id", "s.side", "s.surface")


def copied_pairs(pairs: DataFrame, protected: DataFrame, width: int = 13) -> DataFrame:
    """(pair_id, exact, span): pairs of which a side is a protected row (name, description) or shares a run of `width`
    tokens with one. Both are semi-joins on hashes of keys, confirmed as text."""
    sides = _surfaces(pairs)
    known = protected.select(surface_key("name", "description").alias("surface"))
    exact = sides.join(known, "surface", "left_semi").select("pair_id", F.lit(True).alias("exact"))
    own = sides.select("pair_id", F.explode(token_ngrams(contract_tokens("surface"), width)).alias("gram"))
    grams = known.select(F.explode(token_ngrams(contract_tokens("surface"), width)).alias("gram"))
    span = own.join(grams, "gram", "left_semi").select("pair_id", F.lit(True).alias("span"))
    return exact.distinct().join(span.distinct(), "pair_id", "full")


def _review_agrees(review: str) -> Column:
    """Labels in the order that the hash parity shows the sides, each with evidence from the side it names."""
    swapped = odd_hash(F.col("pair_id"))
    surface = {s: surface_key(F.col(f"{s}.name"), F.col(f"{s}.description")) for s in ("positive", "negative")}
    fold = lambda c: collapse(F.lower(F.coalesce(F.col(f"{review}.{c}"), F.lit(""))))
    a, b = fold("evidence_a"), fold("evidence_b")
    first, second = F.when(swapped, surface["negative"]).otherwise(surface["positive"]), F.when(swapped, surface["positive"]).otherwise(surface["negative"])
    labels = (F.col(f"{review}.label_a") == F.when(swapped, 0).otherwise(1)) & (F.col(f"{review}.label_b") == F.when(swapped, 1).otherwise(0))
    return labels & (a != "") & (b != "") & first.contains(a) & second.contains(b)


def check_pairs(pairs: DataFrame, reviews: DataFrame, audits: DataFrame, cards: DataFrame, protected: DataFrame) -> DataFrame:
    """Pairs with `violations`, `usable` and `sampling_frame`; every broken rule of every pair is named.

    pairs: pair_id, positive and negative (name, description, decisive_span), boundary, style_frame_id, changed_slot,
    changed_field, invariant_fact_frame, positive_first. reviews, audits and cards come 1, 1 and 2 to a pair.
    """
    bundle = pairs
    for name, frame in (("review", reviews), ("audit", audits)):
        packed = frame.groupBy("pair_id").agg(F.count("*").alias(f"n_{name}"), F.max(F.struct(*[c for c in frame.columns if c not in ("pair_id", "checks")])).alias(name))
        bundle = bundle.join(packed, "pair_id", "left")
    held = audits.withColumn("ok", passes(F.col("checks")) & (F.size("checks") > 0)).groupBy("pair_id").agg(F.min("ok").alias("audit_checks"))
    card = F.struct("organizer_label", "pair_position", *_FIELDS, "fully_synthetic", F.col("source_id").isNull().alias("no_id"), F.col("source_component").isNull().alias("no_component"))
    packed = cards.groupBy("pair_id").agg(F.count("*").alias("n_cards"), F.slice(F.array_sort(F.collect_list(card)), 1, 3).alias("cards"))
    seen = _surfaces(pairs).withColumn("n", F.count("*").over(Window.partitionBy("surface"))).groupBy("pair_id").agg(F.max("n").alias("n_surface"))
    bundle = bundle.join(held, "pair_id", "left").join(packed, "pair_id", "left").join(seen, "pair_id", "left").join(copied_pairs(pairs, protected), "pair_id", "left")
    bundle = bundle.withColumn("n_pairs", F.count("*").over(Window.partitionBy("pair_id")))

    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    surfaces = [f"{s}.{f}" for s in ("positive", "negative") for f in _FIELDS] + ["boundary", "style_frame_id", "changed_slot", "changed_field", "invariant_fact_frame"]
    filled = F.lit(True)
    for c in surfaces:
        filled = filled & (text(c) != "")
    bound = lambda s: F.concat(F.col(f"{s}.name"), F.lit("\n"), F.col(f"{s}.description")).contains(F.col(f"{s}.decisive_span"))

    def same(number: int, side: str) -> Column:
        out = F.get("cards", F.lit(number))["organizer_label"] == (1 if side == "positive" else 0)
        for f in _FIELDS:
            out = out & (F.get("cards", F.lit(number))[f] == F.col(f"{side}.{f}"))
        return out

    usable, reason = F.col("review.pair_usable"), F.trim(F.coalesce("review.reject_reason", F.lit("")))
    provenance = F.forall("cards", lambda c: c["fully_synthetic"] & c["no_id"] & c["no_component"])
    in_order = F.forall("cards", lambda c: c["organizer_label"] == ((c["pair_position"] == 0) == F.col("positive_first")).cast("int"))
    rules = {
        "audit_passed": (F.col("n_audit") == 1) & F.col("audit.pass") & F.col("audit_checks") & (F.col("audit.boundary") == F.col("boundary")) & (F.col("audit.style_frame_id") == F.col("style_frame_id")),
        "blind_direction": (F.col("n_review") == 1) & _review_agrees("review"),
        "cards_agree": (F.col("n_cards") == 2) & same(0, "negative") & same(1, "positive"),
        "cards_in_order": in_order,
        "cards_synthetic": provenance,
        "changed_field_known": F.col("changed_field").isin("name", "description"),
        "fields_filled": filled,
        "no_exact_copy": F.col("exact").isNull(),
        "no_shared_span": F.col("span").isNull(),
        "sides_differ": surface_key(F.col("positive.name"), F.col("positive.description")) != surface_key(F.col("negative.name"), F.col("negative.description")),
        "spans_bound": bound("positive") & bound("negative"),
        "surfaces_unique": F.col("n_surface") == 1,
        "unique_id": F.col("n_pairs") == 1,
        "usability_stated": (usable & (reason == "NONE")) | (~usable & ~reason.isin("", "NONE")),
    }
    return bundle.select(*pairs.columns, F.concat_ws("::", "boundary", "style_frame_id").alias("sampling_frame"), usable.alias("usable"), violations(rules).alias("violations"))


def aggregate_gates(checked: DataFrame, expected: int, least_frames: int, most_per_frame: int, direction: float = 1.0, usable: float = 0.9) -> dict[str, int]:
    """The inventory of checked pairs, if it passes: number, frames, the largest frame, direction and usability rates."""
    per_frame = checked.groupBy("sampling_frame").agg(F.count("*").alias("n"))
    frames = per_frame.agg(F.count("*"), F.max("n")).first()
    right = ~F.array_contains("violations", "blind_direction")
    row = checked.agg(F.count("*"), F.count_distinct("boundary"), F.count_if(right), F.count_if("usable"), F.count_if(F.size("violations") > 0)).first()
    found = {"pairs": row[0], "boundaries": row[1], "style_frames": frames[0], "max_pairs_per_style_frame": frames[1] or 0, "blind_direction_correct": row[2], "blind_usable": row[3]}
    broken = [
        name
        for name, ok in (
            ("pairs", row[0] == expected), ("style_frames", frames[0] >= least_frames), ("largest frame", (frames[1] or 0) <= most_per_frame),
            ("direction", row[2] >= direction * row[0]), ("usable", row[3] >= usable * row[0]), ("violations", row[4] == 0),
        )
        if not ok
    ]
    if broken:
        raise ContractError(f"synthetic pairs fail {broken}: {found}")
    return found


def roster_mismatch(pairs: DataFrame, *others: DataFrame) -> DataFrame:
    """Pair ids that are not in all of the tables."""
    ids = pairs.select("pair_id").distinct().withColumn("n", F.lit(1))
    for other in others:
        ids = ids.unionByName(other.select("pair_id").distinct().withColumn("n", F.lit(1)))
    return ids.groupBy("pair_id").agg(F.sum("n").alias("n")).where(F.col("n") < 1 + len(others)).select("pair_id")


def variants(df: DataFrame, out: str) -> DataFrame:
    """Every combination of the values that df's columns have, numbered (`out`) in their order, the last column fastest. The
    values of a column are few, and are held as a list; the combinations are made by exploding lists, in many tasks."""
    lists = [F.array_sort(F.collect_set(c)).alias(f"__{c}") for c in df.columns]
    rows, number = df.agg(*lists), F.lit(0).cast("long")
    for i, c in enumerate(df.columns):
        others = [F.col(x) for d in df.columns[:i] for x in (d, f"__at_{d}")]
        rows = rows.select(*[f"__{d}" for d in df.columns], *others, F.posexplode(f"__{c}").alias(f"__at_{c}", c))
        if i == 0:
            rows = rows.repartition(F.col(c))
        number = number * F.size(f"__{c}") + F.col(f"__at_{c}")
    return rows.select(number.alias(out), *df.columns)


#: Fixed value: what stands for the decisive span in a masked text.
PLACEHOLDER = "{{SLOT}}"


def masked_text(changed: str = "changed_field", side: str = "positive") -> Column:
    """The side's field that the pair does not change, then the one that it does with its decisive span masked, as compared texts."""
    field = lambda own: F.when((F.col(changed) == "name") == F.lit(own), F.col(f"{side}.name")).otherwise(F.col(f"{side}.description"))
    span = F.coalesce(F.col(f"{side}.decisive_span"), F.lit(""))
    template = F.when(span == "", field(True)).otherwise(F.replace(field(True), span, F.lit(PLACEHOLDER)))
    return audit_text(F.concat_ws(" ", F.coalesce(field(False), F.lit("")), F.coalesce(template, F.lit(""))))


def population_audit(pairs: DataFrame, threshold: float = 0.94) -> DataFrame:
    """One row a boundary, and one for all (boundary null): pairs, mean_delta and median_delta, the characters that the positive
    side has more than the negative one; and in every row what holds for all pairs: duplicate_cards, duplicate_masked,
    cross_frame_edges (pairs of pairs of different frames whose masked texts are as near as `threshold`) and max_similarity of such.

    Both fields of both sides count, whole. Equal masked texts are one vector, so copies cost nothing; null fields are empty; a
    null frame is a frame of its own; no pairs give the one row of zeros and nulls.
    """
    length = lambda side: F.length(F.concat(F.coalesce(F.col(f"{side}.name"), F.lit("")), F.coalesce(F.col(f"{side}.description"), F.lit(""))))
    both = F.array(*[audit_text(F.concat_ws(" ", F.coalesce(F.col(f"{s}.name"), F.lit("")), F.coalesce(F.col(f"{s}.description"), F.lit("")))) for s in ("positive", "negative")])
    frame = F.coalesce(F.concat(F.lit("="), F.col("style_frame_id").cast("string")), F.lit(""))
    rows = materialised(pairs.select("boundary", frame.alias("grp"), (length("positive") - length("negative")).cast("long").alias("delta"), F.sha2(both[0], 256).alias("a"), F.sha2(both[1], 256).alias("b"), masked_text().alias("t")).withColumn("h", F.sha2("t", 256)))
    cards = rows.select(F.explode(F.array("a", "b")).alias("c")).agg(F.count("*").alias("n"), F.count_distinct("c").alias("d")).first()
    texts = materialised(rows.groupBy("h").agg(F.first("t").alias("t"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    groups = rows.groupBy("h", "grp").agg(F.count("*").alias("copies")).join(texts.select("h", "id"), "h")
    vectors = similarity.tfidf(texts, "id", spaced_words("t"), padded_ngrams, min_df=1, max_features=None, copies="copies")
    edges, nearest = similarity.cross_group_similarity(vectors, groups, threshold).first()
    n = rows.count()
    middle = medians(rows.where("boundary is not null"), ["boundary"], "delta", "median_delta").unionByName(medians(rows, [], "delta", "median_delta").withColumn("boundary", F.lit(None).cast("string")).where(F.lit(n > 0)))
    means = rows.where("boundary is not null").groupBy("boundary").agg(F.count("*").alias("pairs"), F.avg("delta").alias("mean_delta"))
    means = means.unionByName(rows.agg(F.count("*").alias("pairs"), F.avg("delta").alias("mean_delta")).withColumn("boundary", F.lit(None).cast("string")))
    out = means.join(middle.select(F.col("boundary").alias("of"), "median_delta"), F.col("boundary").eqNullSafe(F.col("of")), "left").drop("of")
    whole = {"duplicate_cards": cards.n - cards.d, "duplicate_masked": n - texts.count(), "cross_frame_edges": edges, "max_similarity": nearest}
    return out.select("*", *[F.lit(v).alias(k) for k, v in whole.items()])

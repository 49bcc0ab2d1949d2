"""Rule overrides, vetoes, result grammar and evidence comments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.text import collapse, count_of, folded, greedy_chunks, keyword_score, middle_truncate, sentences, unescape
from veriloom.session import bound_batches

#: A pattern over policy text that denies the status; \b stands between word and other characters.
NEGATION = (
    r"не\s+(?:является|считается|относится)(?:\s+[а-яa-z-]+){0,6}\s+(?:и|или)\s+бад(?![\p{L}\p{N}_])"
    r"|не\s+(?:является|считается|относится)\s+бад(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])не\s+бад(?![\p{L}\p{N}_])"
)
#: The four text gates, as (field, pattern, wanted) conditions on lower-cased name and description.
RAISE_RULES: tuple[tuple[tuple[str, str, bool], ...], ...] = (
    (("name", r"(?:плита|горелк|печь).{0,80}(?<![\p{L}\p{N}_])и(?![\p{L}\p{N}_]).{0,80}(?:баллон|картридж).{0,20}\d+\s*(?:мл|л(?![\p{L}\p{N}_]))", True),),
    (("name", r"бруск", True), ("description", r"парафин.{0,120}пропитан|пропитан.{0,120}парафин", True)),
)
LOWER_RULES: tuple[tuple[tuple[str, str, bool], ...], ...] = (
    (
        ("name", r"печь", True),
        ("description", r"в качестве топлива использ|топливо.*использ|работает на|требует.*топлив", True),
        ("name", r"баллон|картридж|топливо|газ", False),
    ),
    (
        ("name", r"ролл|растоп|стружк", True),
        ("description", r"без химическ|химическ.{0,80}отсутств|отсутств.{0,80}химическ", True),
        ("description", r"парафин|жидкост|пропитан", False),
    ),
)
#: The result's grammar and the length of its comment.
GRAMMAR = r"(?s)\A<комментарий>(.{50,300})<вердикт>(бан|не бан)\z"
LEAST, MOST = 50, 300
#: Margins of the two prompts that sum to this are positive.
SUM_MARGIN = 0.6875

Rules = Sequence[Sequence[tuple[str, str, bool]]]


def _any(rules: Rules, fields: Mapping[str, Column]) -> Column:
    out = F.lit(False)
    for rule in rules:
        held = F.lit(True)
        for field, pattern, wanted in rule:
            found = fields[field].rlike(pattern)
            held = held & (found if wanted else ~found)
        out = out | held
    return out


def rule_label(name: str, description: str, fallback: Column, raise_: Rules = RAISE_RULES, lower: Rules = LOWER_RULES) -> Column:
    """The fallback label, raised to 1 or lowered to 0 where a rule holds."""
    fields = {"name": F.lower(F.coalesce(F.col(name), F.lit(""))), "description": F.lower(F.coalesce(F.col(description), F.lit("")))}
    return F.when((fallback == 0) & _any(raise_, fields), 1).when((fallback == 1) & _any(lower, fields), 0).otherwise(fallback)


def threshold_veto(strict: Column, broad: Column, text: Column, negation: str = NEGATION, threshold: float = SUM_MARGIN) -> Column:
    """1 where both margins sum to the threshold and the text does not deny the status."""
    return (((strict + broad) >= threshold) & ~text.rlike(negation)).cast("int")


def format_result(label: Column, comment: Column, defaults: Mapping[int, str]) -> Column:
    """The result string; a comment outside the length window becomes the label's default."""
    default = F.when(label == 1, F.lit(defaults[1])).otherwise(F.lit(defaults[0]))
    own = F.trim(F.coalesce(comment, default))
    chosen = F.when(F.length(own).between(LEAST, MOST), own).otherwise(default)
    return F.concat(F.lit("<комментарий>"), chosen, F.lit("<вердикт>"), F.when(label == 1, F.lit("не бан")).otherwise(F.lit("бан")))


def parse_result(result: Column) -> dict[str, Column]:
    """comment and label of a well-formed result, and whether it is one; a line break at the end makes it malformed."""
    ok = F.coalesce(result.rlike(GRAMMAR), F.lit(False))
    return {
        "valid": ok,
        "comment": F.when(ok, F.regexp_extract(result, GRAMMAR, 1)),
        "parsed_label": F.when(ok, (F.regexp_extract(result, GRAMMAR, 2) == "не бан").cast("int")),
    }


def route(df: DataFrame, category: str, branches: Mapping[str, Column], out: str) -> DataFrame:
    """Each row's value from its category's expression; a category without one is an error in the data contract."""
    value = F.lit(None)
    for name, expression in branches.items():
        value = F.when(F.col(category) == name, expression).otherwise(value)
    return df.withColumn(out, value)


#: What stands for a card without any text.
STAND_IN = "Карточка товара"


def evidence(df: DataFrame, id_: str, fields: Sequence[str], keywords: Sequence[str], limit: int | None = 32, chunk: int = 120, stand_in: str = STAND_IN, key: str | None = None, most: int | None = 9000) -> DataFrame:
    """(id, evidence_id, evidence, hits, `key`: the folded text, if asked for): sentences of the fields, cut into chunks; of equal ones (folded) the first; of more
    than `limit` the ones with most keyword hits, in their original order. A field over `most` characters loses its middle.
    None for either keeps all. A card without a piece has one all the same: its first field, cleaned, or `stand_in`."""
    bound_batches(df.sparkSession)
    fit = lambda c: c if most is None else middle_truncate(c, most)
    df = df.select(F.col(id_).alias("id"), *[fit(collapse(F.regexp_replace(unescape(c), "<[^>]*>|\0", " "))).alias(f"c{i}") for i, c in enumerate(fields)])
    cleaned = [F.col(f"c{i}") for i in range(len(fields))]
    pieces = [F.flatten(F.transform(sentences(c), lambda s: greedy_chunks(F.trim(s), chunk))) for c in cleaned]
    spare = F.struct(F.coalesce(F.nullif(cleaned[0], F.lit("")), F.lit(stand_in)).alias("evidence"), F.lit(1).alias("spare"))
    every = F.concat(F.transform(F.concat(*pieces), lambda x: F.struct(x.alias("evidence"), F.lit(0).alias("spare"))), F.array(spare))
    parts = df.select("id", F.posexplode(every).alias("at", "o")).select("id", "at", "o.evidence", "o.spare").withColumn("key", folded("evidence"))
    parts = parts.where("spare = 1 or key <> ''").repartition("id")  # the one exchange of all windows
    first = parts.withColumn("n", F.row_number().over(Window.partitionBy("id", "spare", "key").orderBy("at"))).where("n = 1")
    hits = first.withColumn("hits", F.when(F.col("spare") == 1, 0).otherwise(keyword_score(F.col("key"), tuple(keywords))))
    order = ("spare", "at") if limit is None else ("spare", F.desc("hits"), "at")
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where((F.col("spare") == 0) | (F.col("r") == 1))
    if limit is not None:
        ranked = ranked.where(F.col("r") <= limit)
    return ranked.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1).alias("evidence_id"), "evidence", "hits", *([F.col("key").alias(key)] if key else []))


def marker_score(text: Column, markers: Sequence[str]) -> Column:
    """How many of the markers the text holds."""
    return sum((text.contains(m).cast("int") for m in markers), F.lit(0))


def ladder_score(text: Column, ladder: Sequence[tuple[str, int]]) -> Column:
    """The points of the first pattern found, else 0."""
    out = F.lit(0)
    for pattern, points in reversed(ladder):
        out = F.when(text.rlike(pattern), points).otherwise(out)
    return out


def best_evidence(pieces: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """(id, score, evidence_id, basis): the greatest score, ties to the earlier piece and then the earlier basis."""
    options = F.array(*[F.struct(s.cast("int").alias("score"), F.lit(-i).alias("basis_rank"), F.lit(b).alias("basis")) for i, (b, s) in enumerate(scores.items())])
    rows = pieces.select("id", "evidence_id", F.explode(options).alias("o")).where("o.score > 0")
    best = rows.groupBy("id").agg(F.max(F.struct("o.score", (-F.col("evidence_id")).alias("e"), "o.basis_rank", "o.basis")).alias("m"))
    return best.select("id", F.col("m.score").alias("score"), (-F.col("m.e")).alias("evidence_id"), F.col("m.basis").alias("basis"))


def repair_choice(choices: DataFrame, pieces: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """(id, evidence_id, basis, repaired) from choices (id, evidence_id, basis) that a model made.

    A choice stands if its piece and basis exist and score. Else the best-scoring option replaces it; with none, the
    piece stays if it exists (else the first) and the basis if it is allowed (else the last).
    """
    allowed = list(scores)
    options = F.array(*[F.struct(F.lit(b).alias("basis"), s.cast("int").alias("score")) for b, s in scores.items()])
    scored = pieces.select("id", "evidence_id", F.explode(options).alias("o")).select("id", "evidence_id", "o.basis", "o.score")
    held = scored.where("score > 0").select("id", "evidence_id", "basis", F.lit(True).alias("stands"))
    known = pieces.select("id", "evidence_id", F.lit(True).alias("known"))
    best = best_evidence(pieces, scores).select("id", F.col("evidence_id").alias("best_id"), F.col("basis").alias("best_basis"))
    out = choices.join(held, ["id", "evidence_id", "basis"], "left").join(known, ["id", "evidence_id"], "left").join(best, "id", "left")
    stands = F.col("stands").isNotNull()
    piece = F.when(stands, F.col("evidence_id")).otherwise(F.coalesce("best_id", F.when(F.col("known").isNotNull(), F.col("evidence_id")).otherwise(0)))
    basis = F.when(stands, F.col("basis")).otherwise(F.coalesce("best_basis", F.when(F.col("basis").isin(*allowed), F.col("basis")).otherwise(F.lit(allowed[-1]))))
    return out.select("id", piece.cast("int").alias("evidence_id"), basis.alias("basis"), (~stands).alias("repaired"))


def criticised(repaired: DataFrame, critic: DataFrame, pieces: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """`repaired` (id, evidence_id, basis, repaired), with what a critic (id, action, evidence_id, basis) replaces: only
    choices that had to be repaired, and only by a piece and a basis that exist and score."""
    options = F.array(*[F.struct(F.lit(b).alias("new_basis"), s.cast("int").alias("score")) for b, s in scores.items()])
    held = pieces.select("id", F.col("evidence_id").cast("int").alias("new_id"), F.explode(options).alias("o")).select("id", "new_id", "o.new_basis", "o.score").where("score > 0")
    asked = critic.where("action = 'replace'").select("id", F.col("evidence_id").cast("int").alias("new_id"), F.col("basis").alias("new_basis"))
    found = asked.join(held, ["id", "new_id", "new_basis"], "left_semi")
    out = repaired.join(found, "id", "left")
    taken = F.col("repaired") & F.col("new_id").isNotNull()
    return out.select("id", F.when(taken, F.col("new_id")).otherwise(F.col("evidence_id")).alias("evidence_id"), F.when(taken, F.col("new_basis")).otherwise(F.col("basis")).alias("basis"), "repaired")


def chosen_comments(first: DataFrame, second: DataFrame, choices: DataFrame, sources: DataFrame, fallback: Column) -> DataFrame:
    """(id, comment, source): of two comments (id, evidence, comment) the one that a chooser (id, choice) names, "A" where
    it names none; where that is not valid for the card's text (sources: id, source and what `fallback` needs), the fallback,
    whose source is "fallback". Labels have no part in it and cannot change."""
    both = first.select("id", F.struct("evidence", "comment").alias("a")).join(second.select("id", F.struct("evidence", "comment").alias("b")), "id")
    rows = both.join(choices.select("id", "choice"), "id", "left").join(sources, "id")
    is_b = F.coalesce(F.col("choice") == "B", F.lit(False))
    picked = rows.withColumn("picked", F.when(is_b, F.col("b")).otherwise(F.col("a")))
    valid = F.coalesce(valid_comment(F.col("source"), F.col("picked.evidence"), F.col("picked.comment")), F.lit(False))
    named = F.when(valid, F.when(is_b, F.lit("B")).otherwise(F.lit("A"))).otherwise(F.lit("fallback"))
    return picked.select("id", F.when(valid, F.col("picked.comment")).otherwise(fallback).alias("comment"), named.alias("source"))


def render_comment(piece: Column, phrase: Column) -> Column:
    return F.concat(F.lit("Решающий фрагмент карточки — «"), piece, F.lit("»; он указывает на "), phrase, F.lit("."))


def valid_comment(source: Column, piece: Column, comment: Column) -> Column:
    """Evidence stands in the source, its core in the comment, and the comment is of fit length without markup."""
    anchor = F.regexp_replace(folded(piece), "^[ «»\"'.,;:!?…]+|[ «»\"'.,;:!?…]+$", "")
    fits = F.length(comment).between(LEAST, MOST) & ~comment.contains("<comment>") & ~comment.contains("<verdict>")
    return (anchor != "") & folded(source).contains(folded(piece)) & folded(comment).contains(anchor) & fits


def render_slots(template: Column, slot: Column, placeholder: str = "{{SLOT}}") -> Column:
    """The template with its one placeholder filled; null if it does not hold exactly one."""
    return F.when(count_of(template, placeholder) == 1, F.replace(template, F.lit(placeholder), slot))


#: Vocabulary that a synthetic card must not hold.
META = r"(?iU)organizer|организатор|target|label|метк[аи]|класс\s*[01]|P[123]|N[1-7]|соревнован|датасет"
BRAND = r"(?i)(?<![\p{L}\p{N}_])(weber|zippo|campingaz|kovea|coleman|forester|boyscout|remington|ronson)(?![\p{L}\p{N}_])"
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
SKU = rf"{_EDGE}(?=[A-ZА-Я0-9-]{{6,}}{_EDGE})(?=[A-ZА-Я0-9-]*\d)(?=[A-ZА-Я0-9-]*[A-ZА-Я])[A-ZА-Я0-9-]+{_EDGE}"


def structural_checks(positive: Mapping[str, Column], negative: Mapping[str, Column], changed: Column, placeholder: str = "{{SLOT}}", most: int = 35) -> Column:
    """Map of the nine checks of a synthetic pair. Sides have name, description and span."""
    of = lambda side: F.when(changed == "name", side["name"]).otherwise(side["description"])
    other = lambda side: F.when(changed == "name", side["description"]).otherwise(side["name"])
    both = F.concat_ws(" ", positive["name"], positive["description"], negative["name"], negative["description"])
    masked = lambda side: F.replace(of(side), side["span"], F.lit(placeholder))
    checks = {
        "invariant_field_byte_identical": other(positive) == other(negative),
        "changed_field_differs": of(positive) != of(negative),
        "positive_slot_binds_once": count_of(of(positive), positive["span"]) == 1,
        "negative_slot_binds_once": count_of(of(negative), negative["span"]) == 1,
        "masking_slot_makes_identical": masked(positive) == masked(negative),
        "no_meta_vocabulary": ~both.rlike(META),
        "no_known_real_brand": ~both.rlike(BRAND),
        "no_sku_like_string": ~both.rlike(SKU),
        "balanced_slot_length": F.abs(F.length(positive["span"]) - F.length(negative["span"])) <= most,
    }
    return F.map_from_arrays(F.array(*[F.lit(k) for k in checks]), F.array(*checks.values()))


def passes(checks: Column) -> Column:
    """Whether all checks hold; one that cannot be made, as a side was not rendered, does not."""
    return F.forall(F.map_values(checks), lambda x: F.coalesce(x, F.lit(False)))

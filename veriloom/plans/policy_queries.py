"""Queries of rules, results, evidence comments and synthetic pairs, with the shipped rules over cards that use their words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veriloom.functions.text import collapse, folded, middle_truncate
from veriloom.operators import policy, policy_tables
from veriloom.operators.ranking import medians
from veriloom.plans.cards import CARDS, LABELLED, cards, labelled
from veriloom.plans.query import query
from veriloom.session import materialised, table

DEFAULTS = {
    1: "The card confirms the rules of its category, and no exception takes precedence.",
    0: "The card does not confirm the rules of its category, or an exception takes precedence.",
}
#: Card texts in the words of the shipped rules, put before the tables' own: every name meets every description.
_NAMES = (
    "Печь походная", "Печь газовая", "Плита туристическая и баллон 450 мл", "Горелка и картридж 0.5 л", "Бруски для костра", "Ролл растопочный", "Стружка и парафин", "Набор бальзамов",
)
_BODIES = (
    "Работает на дровах", "В качестве топлива используется уголь", "Бруски, парафин и состав, пропитанный смолой", "отсутствует химическая пропитка", "Без химических добавок",
    "Без химии; жидкость для розжига в комплекте", "Продукт не является лекарством и БАД", "Не БАД, а напиток", "Это БАД к пище, капсулы", "Спортивное питание BCAA и протеин", "Сухое горючее, спички",
    "Набор для розжига и баллон в комплекте", "Дымовая шашка, хлопушка; свеча фонтан", "Горелка заправляемая, переходник", "Сыворотка и крем для наружного применения", "Гриб ежовик, порошок",
    "Бадминтон и чайник", "Не относится к лекарствам или бадам",
)
_IN_WORDS = (
    f"{{cards}}, worded AS (SELECT * EXCLUDE (name, description), {list(_NAMES)}[1 + id % {len(_NAMES)}] || ' ' || name AS name, {list(_BODIES)}[1 + id % {len(_BODIES)} ] || '. ' || description AS description, "
    "CASE WHEN id % 2 = 0 THEN 'БАД' ELSE 'Легковоспламеняющиеся' END AS kind FROM {source})"
)


def _worded(rows):
    """Cards whose name and description begin with the shipped rules' words; kind: one of the two categories."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int"))
    kind = F.when(F.col("id") % 2 == 0, policy_tables.SUPPLEMENT).otherwise(policy_tables.FLAMMABLE)
    return rows.withColumns({"name": F.concat(pick(_NAMES), F.lit(" "), "name"), "description": F.concat(pick(_BODIES), F.lit(". "), "description"), "kind": kind})


# The rules in RE2, which has no \b beyond ASCII and no look-around.
_B = r"[^\p{L}\p{N}_]"


@query(
    "WITH " + _IN_WORDS.format(cards=LABELLED, source="labelled") + ", x AS (SELECT id, label, lower(name) AS n, lower(description) AS d FROM worded) SELECT id, "
    rf"CASE WHEN label = 0 AND (regexp_matches(n, '(?:плита|горелк|печь)(?:.{{0,79}}{_B})и{_B}.{{0,79}}(?:баллон|картридж).{{0,20}}\d+\s*(?:мл|л(?:{_B}|$))') OR (n LIKE '%бруск%' AND regexp_matches(d, 'парафин.{{0,120}}пропитан|пропитан.{{0,120}}парафин'))) THEN 1 "
    "WHEN label = 1 AND ((n LIKE '%печь%' AND regexp_matches(d, 'в качестве топлива использ|топливо.*использ|работает на|требует.*топлив') AND NOT regexp_matches(n, 'баллон|картридж|топливо|газ')) "
    "OR (regexp_matches(n, 'ролл|растоп|стружк') AND regexp_matches(d, 'без химическ|химическ.{0,80}отсутств|отсутств.{0,80}химическ') AND NOT regexp_matches(d, 'парафин|жидкост|пропитан'))) THEN 0 ELSE label END AS ruled FROM x"
)
def rule_override(spark, sf_dir):
    return _worded(labelled(spark, sf_dir)).select("id", policy.rule_label("name", "description", F.col("label")).alias("ruled"))


def _mock(ns: str, id_: str = "id") -> str:
    return f"((((('0x' || substr(sha256('{ns}' || chr(0) || {id_}::VARCHAR), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615.0::DOUBLE) * 2) - 1)"


_DENIED = (
    rf"не\s+(?:является|считается|относится)(?:\s+[а-яa-z-]+){{0,6}}\s+(?:и|или)\s+бад(?:{_B}|$)|не\s+(?:является|считается|относится)\s+бад(?:{_B}|$)|(?:^|{_B})не\s+бад(?:{_B}|$)"
)


@query("WITH " + _IN_WORDS.format(cards=CARDS, source="cards") + f" SELECT id, ({_mock('strict')} + {_mock('broad')} >= 0.6875 AND NOT regexp_matches(lower(name || chr(10) || description), '{_DENIED}'))::INT AS prediction FROM worded")
def threshold_veto(spark, sf_dir):
    from veriloom.functions.hashing import mock_margin

    text = F.lower(F.concat("name", F.lit("\n"), "description"))
    return _worded(cards(spark, sf_dir)).select("id", policy.threshold_veto(mock_margin("strict", F.col("id")), mock_margin("broad", F.col("id")), text).alias("prediction"))


_RESULT = (
    "'<комментарий>' || CASE WHEN length(trim(name)) BETWEEN 50 AND 300 THEN trim(name) WHEN label = 1 THEN '" + DEFAULTS[1] + "' ELSE '" + DEFAULTS[0] + "' END || '<вердикт>' || CASE WHEN label = 1 THEN 'не бан' ELSE 'бан' END"
)


@query("WITH " + LABELLED + f" SELECT id, {_RESULT} AS result FROM labelled")
def format_result(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", policy.format_result(F.col("label"), F.col("name"), DEFAULTS).alias("result"))


@query("WITH " + LABELLED + f", r AS (SELECT id, ({_RESULT}) || CASE WHEN id % 5 = 0 THEN chr(10) ELSE '' END AS result FROM labelled) SELECT id, id % 5 <> 0 AS valid, CASE WHEN id % 5 <> 0 THEN regexp_extract(result, '(?s)^<комментарий>(.*)<вердикт>', 1) END AS comment, CASE WHEN id % 5 <> 0 THEN (result LIKE '%<вердикт>не бан')::INT END AS parsed_label FROM r")
def parse_result(spark, sf_dir):
    """Every fifth result ends in a line break, which makes it malformed."""
    result = F.concat(policy.format_result(F.col("label"), F.col("name"), DEFAULTS), F.when(F.col("id") % 5 == 0, F.lit("\n")).otherwise(F.lit("")))
    return labelled(spark, sf_dir).withColumn("result", result).select("id", *[c.alias(n) for n, c in policy.parse_result(F.col("result")).items()])


_KEYS = ("tion", "ing", "the", "licen")
_HITS = " + ".join(f"((length(k) - length(replace(k, '{w}', ''))) // {len(w)})" for w in _KEYS)


def _evidence(spark, sf_dir, key=None, **bounds):
    """Pieces of whole cards by the policy's keywords: (id, evidence_id, evidence, hits, `key`: the folded text, if asked for)."""
    rows = _worded(cards(spark, sf_dir)).select("id", "name", "description", "kind")
    each = [policy.evidence(rows.where(F.col("kind") == kind), "id", ("name", "description"), words, key=key, **bounds) for kind, words in policy_tables.KEYWORDS.items()]
    return each[0].union(each[1])


def _count_sql(words) -> str:
    return " + ".join(f"((length(k) - length(replace(k, '{w}', ''))) // {len(w)})" for w in words)


_SPLIT = r"string_split(regexp_replace(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), '[;\n]+', chr(1), 'g'), chr(1))"
# Fields, sentences, then words; a piece takes words while it stays within 120 characters.
_EVIDENCE = "WITH RECURSIVE " + _IN_WORDS.format(cards=CARDS, source="cards") + r""",
flat AS (SELECT id, kind, f, trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM (SELECT id, kind, 0 AS f, name AS x FROM worded UNION ALL SELECT id, kind, 1, description FROM worded)),
cut AS (SELECT id, kind, f, CASE WHEN length(x) <= 9000 THEN x ELSE x[1:6000] || ' … ' || x[-3000:] END AS x FROM flat),
s AS (SELECT id, kind, f, unnest(""" + _SPLIT + ") AS s, generate_subscripts(" + _SPLIT + r""", 1) AS si FROM cut),
w AS (SELECT id, kind, f, si, list_filter(string_split(trim(s), ' '), lambda x: x <> '') AS ws FROM s WHERE trim(s) <> ''),
pack(id, kind, f, si, ws, i, n, cur) AS (SELECT id, kind, f, si, ws, 2, 0, ws[1] FROM w UNION ALL
  SELECT id, kind, f, si, ws, i + 1, CASE WHEN length(cur || ' ' || ws[i]) > 120 THEN n + 1 ELSE n END, CASE WHEN length(cur || ' ' || ws[i]) > 120 THEN ws[i] ELSE cur || ' ' || ws[i] END FROM pack WHERE i <= len(ws)),
pieces AS (SELECT id, kind, f, si, n, arg_max(cur, i) AS evidence FROM pack GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, lower(evidence) AS k, row_number() OVER (PARTITION BY id, lower(evidence) ORDER BY f, si, n) AS dup FROM pieces),
h AS (SELECT id, kind, f, si, n, evidence, k, CASE kind """ + " ".join(f"WHEN '{kind}' THEN {_count_sql(words)}" for kind, words in policy_tables.KEYWORDS.items()) + r""" END::INT AS hits FROM k WHERE dup = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, f, si, n) AS r FROM h),
evidence AS (SELECT id, kind, (row_number() OVER (PARTITION BY id ORDER BY f, si, n) - 1)::INT AS evidence_id, evidence, k, hits FROM r WHERE r <= 32)"""


_EVERY_PIECE = _EVIDENCE.replace("CASE WHEN length(x) <= 9000 THEN x ELSE x[1:6000] || ' … ' || x[-3000:] END AS x", "x").replace(" FROM r WHERE r <= 32)", " FROM r)")


@query(_EVERY_PIECE + " SELECT id, evidence_id, evidence FROM evidence")
def evidence_split(spark, sf_dir):
    """All pieces of whole fields; the others keep the policy's window and its 32 best pieces."""
    return _evidence(spark, sf_dir, limit=None, most=None).select("id", "evidence_id", "evidence")


@query(_EVIDENCE + " SELECT id, evidence_id, hits FROM evidence")
def topk_restore_order(spark, sf_dir):
    return _evidence(spark, sf_dir).select("id", "evidence_id", "hits")


@query("SELECT doc_id AS id, (" + _HITS.replace("length(k)", "length(lower(text))").replace("replace(k,", "replace(lower(text),") + ")::INT AS hits FROM documents")
def keyword_score(spark, sf_dir):
    from veriloom.functions.text import keyword_score as score

    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), score(F.lower("text"), _KEYS).alias("hits"))


# The ladders of candidate B in RE2; a basis that is not here has 3 points for any marker.
_W = r"[\p{L}\p{N}_]"
_RUNGS = {
    "explicit_bad_status": ((f"regexp_matches(k, 'биологически активн{_W}* добавк|пищев{_W}* добавк|бад к пище')", 6), (f"regexp_matches(k, 'supplement|(?:^|{_B})бад(?:{_B}|$)')", 4)),
    "explicit_not_bad": (("regexp_matches(k, 'не является.{0,35}(?:бад|биологически активн)')", 8),),
    "sport_nutrition": ((f"regexp_matches(k, 'спортивн{_W}* питан|(?:^|{_B})(?:bcaa|бцаа)(?:{_B}|$)|протеин|предтренировоч')", 5),),
    "ordinary_food": ((f"regexp_matches(k, '(?:^|{_B})(?:напиток|сок|чай|кофе|батончик|конфета|еда)(?:{_B}|$)')", 4),),
    "sold_fuel": (("regexp_matches(k, 'сухое горючее|топлив|бензин|горючий материал|угол[ья]|брикет')", 6),),
    "ignition_source": ((f"regexp_matches(k, 'спич|набор.{{0,20}}розжиг|средств{_W}* розжиг|зажигал')", 5),),
    "included_flammable_content": ((f"regexp_matches(k, 'в комплект|в состав.{{0,20}}набор') AND regexp_matches(k, 'горюч|топлив|спич|газов{_W}* баллон|бензин')", 7),),
    "pyrotechnic_article": ((f"regexp_matches(k, 'хлопуш|дымовая шашка|цветн{_W}* дым|пиротех|фейервер|бенгальск|свеч{_W}* фонтан')", 6),),
    "refillable_flame_device": (("regexp_matches(k, 'перезаправ|заправляем|газовая зажигал')", 6),),
    "device_only": (("regexp_matches(k, 'плита|горелка|устройство|гриль')", 5),),
}
#: Stand-in labels of cards that have none: every third is positive.
_LABEL_SQL = "(id % 3 = 0)::INT"
_GROUPS = tuple((kind, label) for kind in policy_tables.KEYWORDS for label in (1, 0))


def _points_sql(basis: str) -> str:
    if basis in _RUNGS:
        return "CASE " + " ".join(f"WHEN {found} THEN {points}" for found, points in _RUNGS[basis]) + " ELSE 0 END"
    return "CASE WHEN " + " OR ".join(f"contains(k, '{m}')" for m in policy_tables.MARKERS[basis]) + " THEN 3 ELSE 0 END"


_SCORED = _EVIDENCE + ", o AS (" + " UNION ALL ".join(
    f"SELECT id, evidence_id, '{basis}' AS basis, {i} AS bi, {_points_sql(basis)} AS score FROM evidence WHERE kind = '{kind}' AND {_LABEL_SQL} = {label}"
    for kind, label in _GROUPS
    for i, basis in enumerate(policy_tables.allowed(kind, label, "B"))
) + ")"


def _points():
    """Each category and label: which cards are its own, and the points of its bases over the folded text k."""
    for kind, label in _GROUPS:
        mine = (F.col("id") % 2 == (0 if kind == policy_tables.SUPPLEMENT else 1)) & ((F.col("id") % 3 == 0).cast("int") == label)
        yield mine, policy_tables.scores(F.col("k"), policy_tables.allowed(kind, label, "B"), "B")


def _groups(spark, sf_dir):
    """Each category and label: its pieces, with the folded text k, and the points of its bases. Pieces are written once."""
    rows = materialised(_evidence(spark, sf_dir, "k"))
    for mine, points in _points():
        yield mine, rows.where(mine), list(points), points


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query(_SCORED + " SELECT id, evidence_id, basis, score FROM o WHERE score > 0")
def weighted_evidence(spark, sf_dir):
    """Every card is of one group, so the pieces are read once, with the points of their group."""
    options = F.lit(None)
    for mine, points in _points():
        own = F.array(*[F.struct(F.lit(b).alias("basis"), p.cast("int").alias("score")) for b, p in points.items()])
        options = F.when(mine, own).otherwise(options)
    # An inner explode would be put behind a filter on the array's size, which makes all points a second time.
    rows = _evidence(spark, sf_dir, "k").select("id", "evidence_id", F.explode_outer(options).alias("o"))
    return rows.select("id", "evidence_id", "o.basis", "o.score").where("score > 0")


_BEST = _SCORED + ", best AS (SELECT id, score, evidence_id, basis FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, evidence_id, bi) AS r FROM o WHERE score > 0) WHERE r = 1)"


@query(_BEST + " SELECT id, score, evidence_id, basis FROM best")
def argmax_evidence(spark, sf_dir):
    return _union(policy.best_evidence(rows, points) for _, rows, _, points in _groups(spark, sf_dir))


_FIRST_BASIS = "CASE " + " ".join(f"WHEN kind = '{k}' AND {_LABEL_SQL} = {v} THEN '{policy_tables.allowed(k, v, 'B')[0]}'" for k, v in _GROUPS) + " END"
_LAST_BASIS = "CASE " + " ".join(f"WHEN kind = '{k}' AND {_LABEL_SQL} = {v} THEN '{policy_tables.allowed(k, v, 'B')[-1]}'" for k, v in _GROUPS) + " END"


@query(
    _BEST + f", c AS (SELECT id, (id % 9 - 1)::INT AS evidence_id, CASE WHEN id % 4 < 2 THEN 'nonsense' ELSE {_FIRST_BASIS} END AS basis, {_LAST_BASIS} AS last FROM worded) "
    "SELECT c.id, (CASE WHEN o.score > 0 THEN c.evidence_id WHEN b.id IS NOT NULL THEN b.evidence_id WHEN e.id IS NOT NULL THEN c.evidence_id ELSE 0 END)::INT AS evidence_id, "
    "CASE WHEN o.score > 0 THEN c.basis WHEN b.id IS NOT NULL THEN b.basis WHEN c.basis <> 'nonsense' THEN c.basis ELSE c.last END AS basis, NOT coalesce(o.score > 0, false) AS repaired "
    "FROM c LEFT JOIN o ON o.id = c.id AND o.evidence_id = c.evidence_id AND o.basis = c.basis LEFT JOIN best b ON b.id = c.id LEFT JOIN evidence e ON e.id = c.id AND e.evidence_id = c.evidence_id"
)
def comment_repair(spark, sf_dir):
    """Choices made up by id, some of them out of range or not allowed."""
    ids = cards(spark, sf_dir).select("id")

    def repaired(mine, rows, bases, points):
        basis = F.when(F.col("id") % 4 < 2, "nonsense").otherwise(bases[0])
        return policy.repair_choice(ids.where(mine).select("id", (F.col("id") % 9 - 1).cast("int").alias("evidence_id"), basis.alias("basis")), rows, points)

    return _union(repaired(*group) for group in _groups(spark, sf_dir))


_REPAIRED = (
    _BEST + f", c AS (SELECT id, (id % 9 - 1)::INT AS evidence_id, CASE WHEN id % 4 < 2 THEN 'nonsense' ELSE {_FIRST_BASIS} END AS basis, {_FIRST_BASIS} AS first, {_LAST_BASIS} AS last FROM worded), "
    "mended AS (SELECT c.id, (CASE WHEN o.score > 0 THEN c.evidence_id WHEN b.id IS NOT NULL THEN b.evidence_id WHEN e.id IS NOT NULL THEN c.evidence_id ELSE 0 END)::INT AS evidence_id, "
    "CASE WHEN o.score > 0 THEN c.basis WHEN b.id IS NOT NULL THEN b.basis WHEN c.basis <> 'nonsense' THEN c.basis ELSE c.last END AS basis, NOT coalesce(o.score > 0, false) AS repaired, c.first "
    "FROM c LEFT JOIN o ON o.id = c.id AND o.evidence_id = c.evidence_id AND o.basis = c.basis LEFT JOIN best b ON b.id = c.id LEFT JOIN evidence e ON e.id = c.id AND e.evidence_id = c.evidence_id), "
    "judged AS (SELECT m.id, CASE WHEN m.repaired AND x.score > 0 THEN x.evidence_id ELSE m.evidence_id END AS evidence_id, CASE WHEN m.repaired AND x.score > 0 THEN x.basis ELSE m.basis END AS basis, m.repaired "
    "FROM mended m LEFT JOIN o x ON x.id = m.id AND m.id % 3 <> 1 AND x.evidence_id = m.id % 3 AND x.basis = m.first)"
)


def _judged(spark, sf_dir):
    """Choices made up by id, repaired, and judged by a critic that is made up too."""
    ids = cards(spark, sf_dir).select("id")

    def judged(mine, rows, bases, points):
        basis = F.when(F.col("id") % 4 < 2, "nonsense").otherwise(bases[0])
        own = ids.where(mine)
        mended = policy.repair_choice(own.select("id", (F.col("id") % 9 - 1).cast("int").alias("evidence_id"), basis.alias("basis")), rows, points)
        critic = own.select("id", F.when(F.col("id") % 3 == 1, "keep").otherwise("replace").alias("action"), (F.col("id") % 3).cast("int").alias("evidence_id"), F.lit(bases[0]).alias("basis"))
        return policy.criticised(mended, critic, rows, points)

    return _union(judged(*group) for group in _groups(spark, sf_dir))


@query(_REPAIRED + " SELECT id, evidence_id, basis, repaired FROM judged")
def comment_critic(spark, sf_dir):
    return _judged(spark, sf_dir)


_PHRASE = "CASE basis " + " ".join(f"WHEN '{b}' THEN '{policy_tables.phrase(b, 'B')}'" for b in policy_tables.PHRASES) + " END"
_COMMENT = f"'Решающий фрагмент карточки — «' || e.evidence || '»; он указывает на ' || {_PHRASE} || '.'"


@query(_BEST + f" SELECT b.id, {_COMMENT} AS comment, length({_COMMENT}) BETWEEN 50 AND 300 AS valid FROM best b JOIN evidence e USING (id, evidence_id)")
def comment_render(spark, sf_dir):
    """Of pieces that were cut out of a field as they stand, all are in their source."""
    source = F.concat_ws(" ", *[middle_truncate(collapse(F.regexp_replace(c, "<[^>]*>", " ")), 9000) for c in ("name", "description")])
    whole = _worded(cards(spark, sf_dir)).select("id", source.alias("source"))
    pieces = _evidence(spark, sf_dir).select("id", "evidence_id", "evidence")
    joined = argmax_evidence(spark, sf_dir).join(pieces, ["id", "evidence_id"]).join(whole, "id")
    phrase = F.element_at(F.create_map(*[F.lit(x) for b in policy_tables.PHRASES for x in (b, policy_tables.phrase(b, "B"))]), F.col("basis"))
    comment = policy.render_comment(F.col("evidence"), phrase)
    return joined.select("id", comment.alias("comment"), policy.valid_comment(F.col("source"), F.col("evidence"), comment).alias("valid"))


_FALLBACK = "CASE " + " ".join(f"WHEN w.kind = '{k}' AND {_LABEL_SQL.replace('id', 'w.id')} = {v} THEN '{t}'" for (k, v), t in policy_tables.FALLBACK.items()) + " END"
_OF_A = "'Решающий фрагмент карточки — «' || p.evidence || '»; он указывает на ' || " + _PHRASE.replace("CASE basis", "CASE j.basis") + " || '.'"


@query(
    _REPAIRED + f", first_ AS (SELECT id, evidence, evidence AS comment FROM evidence WHERE evidence_id = 0), second_ AS (SELECT j.id, p.evidence, {_OF_A} AS comment FROM judged j JOIN evidence p USING (id, evidence_id)), "
    "pick AS (SELECT w.id, CASE WHEN w.id % 5 < 3 THEN 'B' ELSE 'A' END AS source, CASE WHEN w.id % 5 < 3 THEN s.comment ELSE f.comment END AS comment, " + _FALLBACK + " AS fallback FROM worded w JOIN first_ f USING (id) JOIN second_ s USING (id)) "
    "SELECT id, CASE WHEN length(comment) BETWEEN 50 AND 300 THEN comment ELSE fallback END AS comment, CASE WHEN length(comment) BETWEEN 50 AND 300 THEN source ELSE 'fallback' END AS source FROM pick"
)
def comment_choice(spark, sf_dir):
    """The first comment is a bare piece, too short for some cards; the chooser is made up, and at times names neither."""
    rows = _worded(cards(spark, sf_dir))
    source = F.concat_ws(" ", *[middle_truncate(collapse(F.regexp_replace(c, "<[^>]*>", " ")), 9000) for c in ("name", "description")])
    sources = rows.select("id", "kind", source.alias("source"))
    pieces = _evidence(spark, sf_dir).select("id", "evidence_id", "evidence")
    phrase = F.element_at(F.create_map(*[F.lit(x) for b in policy_tables.PHRASES for x in (b, policy_tables.phrase(b, "B"))]), F.col("basis"))
    first = pieces.where("evidence_id = 0").select("id", "evidence", F.col("evidence").alias("comment"))
    second = _judged(spark, sf_dir).join(pieces, ["id", "evidence_id"]).select("id", "evidence", policy.render_comment(F.col("evidence"), phrase).alias("comment"))
    choices = rows.where("id % 5 <> 4").select("id", F.when(F.col("id") % 5 < 3, "B").otherwise("A").alias("choice"))
    fallback = F.lit(None).cast("string")
    for (kind, label), text in policy_tables.FALLBACK.items():
        fallback = F.when((F.col("kind") == kind) & ((F.col("id") % 3 == 0).cast("int") == label), text).otherwise(fallback)
    return policy.chosen_comments(first, second, choices, sources, fallback)


@query("WITH " + LABELLED + f" SELECT id, CASE WHEN label = 1 THEN '{DEFAULTS[1]}' ELSE '{DEFAULTS[0]}' END AS comment FROM labelled WHERE length(trim(name)) NOT BETWEEN 50 AND 300")
def comment_fallback(spark, sf_dir):
    rows = labelled(spark, sf_dir).where(~F.length(F.trim("name")).between(50, 300))
    return rows.select("id", F.when(F.col("label") == 1, DEFAULTS[1]).otherwise(DEFAULTS[0]).alias("comment"))


_PAIR = """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'name' ELSE 'description' END AS changed, p_name AS slot_a, 'no ' || p_type AS slot_b, p_brand || ' box' AS fixed,
CASE WHEN p_partkey % 13 = 0 THEN 'two {{SLOT}} and {{SLOT}}' ELSE 'set with {{SLOT}} inside' END AS template FROM part"""
_ONCE = "(length(template) - length(replace(template, '{{SLOT}}', ''))) // 8 = 1"


def _templates(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "name").otherwise("description").alias("changed"), F.col("p_name").alias("slot_a"),
        F.concat(F.lit("no "), "p_type").alias("slot_b"), F.concat("p_brand", F.lit(" box")).alias("fixed"),
        F.when(F.col("p_partkey") % 13 == 0, "two {{SLOT}} and {{SLOT}}").otherwise("set with {{SLOT}} inside").alias("template"),
    )


@query(f"WITH p AS ({_PAIR}) SELECT id, changed, CASE WHEN {_ONCE} THEN replace(template, '{{{{SLOT}}}}', slot_a) END AS positive, CASE WHEN {_ONCE} THEN replace(template, '{{{{SLOT}}}}', slot_b) END AS negative FROM p")
def render_slots(spark, sf_dir):
    return _templates(spark, sf_dir).select("id", "changed", policy.render_slots(F.col("template"), F.col("slot_a")).alias("positive"), policy.render_slots(F.col("template"), F.col("slot_b")).alias("negative"))


#: Faults of the field that does not change, by row; the last differs between the sides.
_FAULTS = ((17, "Zippo case"), (19, "box AB123-"), (23, "label here"), (29, None))


def _audited(spark, sf_dir):
    """Checks of synthetic pairs, some with two slots, a brand, an article number, meta words or two unlike fields."""
    rows = _templates(spark, sf_dir)
    fixed = F.col("fixed")
    for step, fault in _FAULTS[:3]:
        fixed = F.when(F.col("id") % step == 0, F.lit(fault)).otherwise(fixed)
    other = F.when(F.col("id") % _FAULTS[3][0] == 0, F.concat(fixed, F.lit("!"))).otherwise(fixed)
    side = lambda slot, field: {
        "name": F.when(F.col("changed") == "name", policy.render_slots(F.col("template"), F.col(slot))).otherwise(field),
        "description": F.when(F.col("changed") == "name", field).otherwise(policy.render_slots(F.col("template"), F.col(slot))),
        "span": F.col(slot),
    }
    return rows.withColumn("checks", policy.structural_checks(side("slot_a", fixed), side("slot_b", other), F.col("changed")))


_BY_ID = "CASE WHEN id % 23 = 0 THEN 'label here' WHEN id % 19 = 0 THEN 'box AB123-' WHEN id % 17 = 0 THEN 'Zippo case' ELSE fixed END"
_AUDIT = f"""WITH p AS ({_PAIR}), r AS (SELECT * EXCLUDE (fixed), {_BY_ID} AS fa, ({_BY_ID}) || CASE WHEN id % 29 = 0 THEN '!' ELSE '' END AS fb,
  CASE WHEN {_ONCE} THEN 'set with ' || slot_a || ' inside' END AS a, CASE WHEN {_ONCE} THEN 'set with ' || slot_b || ' inside' END AS b FROM p),
c AS (SELECT id, changed, a IS NOT NULL AND a <> b AS differs, fa = fb AS fixed_alike, coalesce((length(a) - length(replace(a, slot_a, ''))) / length(slot_a) = 1, false) AS once_a, coalesce((length(b) - length(replace(b, slot_b, ''))) / length(slot_b) = 1, false) AS once_b,
  coalesce(replace(a, slot_a, '{{{{SLOT}}}}') = replace(b, slot_b, '{{{{SLOT}}}}'), false) AS masked, abs(length(slot_a) - length(slot_b)) <= 35 AS balanced,
  NOT regexp_matches(lower(concat_ws(' ', a, b, fa, fb)), 'organizer|target|label|p[123]|n[1-7]') AS clean, NOT regexp_matches(lower(concat_ws(' ', a, b, fa, fb)), '\\b(?:zippo|weber|kovea|coleman)\\b') AS no_brand,
  -- A hyphen may end an article number only before a word character.
  len(list_filter(regexp_extract_all(concat_ws(' ', a, b, fa, fb), '[A-Za-z0-9_-]+'), lambda x: regexp_matches(regexp_replace(x, '^-+|-+$', '', 'g'), '^[A-Z0-9-]{{6,}}$') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]'))) = 0 AS no_sku FROM r)"""


@query(_AUDIT + " SELECT id, changed, differs AND fixed_alike AND once_a AND once_b AND masked AND balanced AND clean AND no_brand AND no_sku AS passed FROM c")
def structural_audit(spark, sf_dir):
    return _audited(spark, sf_dir).select("id", "changed", policy.passes(F.col("checks")).alias("passed"))


@query(_AUDIT + " SELECT changed, count(*) AS n, count(*) FILTER (masked) AS masked, count(*) FILTER (once_a AND once_b) AS bound, count(*) FILTER (NOT differs) AS unrendered, round(avg(balanced::INT), 9) AS balanced_rate FROM c GROUP BY 1")
def audit_rates(spark, sf_dir):
    check = lambda name: F.coalesce(F.col("checks")[name], F.lit(False))
    return _audited(spark, sf_dir).groupBy("changed").agg(
        F.count("*").alias("n"), F.count_if(check("masking_slot_makes_identical")).alias("masked"),
        F.count_if(check("positive_slot_binds_once") & check("negative_slot_binds_once")).alias("bound"), F.count_if(~check("changed_field_differs")).alias("unrendered"),
        F.round(F.avg(check("balanced_slot_length").cast("int")), 9).alias("balanced_rate"),
    )


@query(f"WITH p AS ({_PAIR}) SELECT changed, round(avg(length(slot_a) - length(slot_b)), 9) AS mean_delta, round(median(length(slot_a) - length(slot_b)), 9) AS median_delta FROM p GROUP BY 1")
def length_balance(spark, sf_dir):
    rows = _templates(spark, sf_dir).select("changed", (F.length("slot_a") - F.length("slot_b")).alias("delta"))
    middle = medians(rows, ["changed"], "delta", "m").select(F.col("changed").alias("of"), F.round("m", 9).alias("median_delta"))
    means = rows.groupBy("changed").agg(F.round(F.avg("delta"), 9).alias("mean_delta"))
    return means.join(middle, F.col("changed").eqNullSafe(F.col("of")), "left").drop("of")

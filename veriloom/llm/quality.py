"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.rows import hold, named, release
from veriloom.llm.textbytes import LETTERS, LOWER, mix, prefix_hash, slices, span, words
from veriloom.session import bound_batches, materialised

#: Labelled rows that the classifier is fitted on at most (taken in hash order), and its lexicon's size.
SAMPLE_ROWS, LEXICON = 20_000, 4_000
#: Sites that are sent to every task at most; beyond, rows are joined by shuffle.
BROADCAST_SITES = 100_000
#: Bytes of a word's head, which is a feature beside the whole word.
HEAD = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "%*#$&!|~^=+<>{}[]@\\_"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
N_STYLE = 8


def _token_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two features a word: the word and its head of HEAD bytes, marked apart."""
    prefix = prefix_hash(low)
    whole = mix(span(prefix, starts, ends) + np.uint64(1))
    head = mix(span(prefix, starts, np.minimum(starts + HEAD, ends)) + np.uint64(2))
    return np.stack([whole, head])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def style(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Shares that set prose apart from junk, one row per text; each lies within [0, 1]. hashes: of the words."""
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets)).astype(np.float64)
    n_words = np.bincount(owner, minlength=n).astype(np.float64)
    letters = np.bincount(owner, ends - starts, minlength=n)
    out = np.empty((n, N_STYLE))
    out[:, 0] = _sums(_SYMBOLS[data], offsets) / size
    out[:, 1] = np.minimum(1, _sums(_SYMBOLS[data], offsets) / np.maximum(1, n_words))
    out[:, 2] = _sums(_UPPER[data], offsets) / size
    out[:, 3] = np.minimum(1, _sums(data == 0x7C, offsets) / np.maximum(1, n_words))
    out[:, 4] = letters / size
    out[:, 5] = np.minimum(1, letters / np.maximum(1, n_words) / 16)
    out[:, 6] = _sums(_SPACES[data], offsets) / size
    # A text's number and 40 bits of a word's hash in one sortable word.
    keyed = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(keyed), bool)
    fresh[1:] = keyed[1:] != keyed[:-1]
    out[:, 7] = 1 - np.bincount((keyed[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(1, n_words)
    return out


@dataclass
class Model:
    """Lexicon (sorted feature hashes and log-odds) and logistic weights of each target; prior: the sample's log-odds."""

    lexicon: list[tuple[np.ndarray, np.ndarray]]
    weights: list[np.ndarray]
    prior: list[float]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[text, target, feature]: 1, style, log count of lexicon words, and their greatest log-odds."""
    low = LOWER[data]
    starts, ends, owner = words(low, offsets, LETTERS)
    tokens = _token_hashes(low, starts, ends)
    shape = style(data, offsets, starts, ends, owner, tokens[0])
    n = len(shape)
    out = np.zeros((n, len(lexicon), N_STYLE + 3))
    out[:, :, 0] = 1
    out[:, :, 1 : N_STYLE + 1] = shape[:, None, :]
    for t, (known, odds) in enumerate(lexicon):
        if not len(known):
            continue
        low_bits = np.zeros(1 << 16, bool)
        low_bits[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        best = np.zeros(len(starts))
        for h in tokens:
            maybe = np.flatnonzero(low_bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            best[maybe] = np.maximum(best[maybe], np.where(known[at] == h[maybe], odds[at], 0))
        found = np.flatnonzero(best)
        out[:, t, N_STYLE + 1] = np.log1p(np.bincount(owner[found], minlength=n))
        if len(found):
            of = owner[found]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            out[of[first], t, N_STYLE + 2] = np.maximum.reduceat(best[found], first) / 4
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the intercept is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, lexicon: int = LEXICON) -> Model:
    """Fits on at most `sample_rows` labelled documents: targets are low quality and toxicity.

    The lexicon of a target is the words and word heads that are frequent among its documents and rare in others,
    counted by grouped aggregation. The sample itself, as features, is collected. Labels without a document,
    or null, are left out; a target without both classes gets no evidence.
    """
    rated = labels.where("quality is not null and toxic is not null").groupBy(key).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rated = rated.select(key, (1 - F.col("quality")).cast("int").alias("bad"), F.col("toxic").cast("int").alias("toxic"))
    rated = rated.orderBy(F.xxhash64(key), key).limit(sample_rows)
    # At most sample_rows rows of two numbers and a key, so texts are picked out where they are read.
    texts = documents.select(named(key).alias("key"), F.coalesce(named(text), F.lit("")).alias("text"))
    sample = materialised(texts.join(F.broadcast(rated.withColumnRenamed(key, "key")), "key").select("text", "bad", "toxic"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                low = LOWER[data]
                starts, ends, owner = words(low, offsets, LETTERS)
                both = _token_hashes(low, starts, ends).ravel()
                who = np.concatenate([owner, owner])
                order = np.lexsort((both, who))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (both[order][1:] != both[order][:-1]) | (who[order][1:] != who[order][:-1])
                order = order[fresh]
                bad, toxic = (rows.column(c).to_numpy() for c in ("bad", "toxic"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[order].view(np.int64)), pa.array(bad[who[order]]), pa.array(toxic[who[order]])], names=["token", "bad", "toxic"]
                )

    n, *of_class = sample.agg(F.count("*"), F.sum("bad"), F.sum("toxic")).first()
    counted = sample.mapInArrow(tokens, "token long, bad int, toxic int").groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic"))
    chosen = []
    for target, total in zip(("bad", "toxic"), of_class, strict=True):
        if not n or not total or total == n:
            chosen.append((np.zeros(0, np.uint64), np.zeros(0)))
            continue
        inside, outside = F.col(target), F.col("n") - F.col(target)
        odds = F.log((inside + 0.5) / (total + 1)) - F.log((outside + 0.5) / (n - total + 1))
        often = (inside >= max(3, 0.01 * total)) & (odds >= 3.0)
        top = counted.where(often).select("token", odds.alias("odds"), inside.alias("c")).orderBy(F.desc("c"), "token").limit(lexicon).collect()
        hashes = np.array([r[0] for r in top], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        chosen.append((hashes[order], np.array([r[1] for r in top], float)[order]))
    width = N_STYLE + 3

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                x = features(data, offsets, chosen).reshape(rows.num_rows, -1)
                yield pa.RecordBatch.from_arrays([rows.column("bad"), rows.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["bad", "toxic", "x"])

    # At most sample_rows rows, put in one order so that sums are the same in every run.
    held = sorted(sample.mapInArrow(vectors, "bad int, toxic int, x array<double>").collect())
    x = np.array([r[2] for r in held], float).reshape(len(held), len(chosen), width)
    weights, prior = [], []
    for t, total in enumerate(of_class):
        if not n or not total or total == n:
            weights.append(np.zeros(width))
            prior.append(0.0)
            continue
        y = np.array([r[t] for r in held], float)
        weights.append(_logistic(x[:, t], y))
        prior.append(float(np.log(total / (n - total))))
    return Model(chosen, weights, prior)


def evidence(rows: DataFrame, model: Model, keep_text: bool) -> DataFrame:
    """rows (text and others), with bad and toxic: the text's log-likelihood ratios for low quality and toxicity."""
    names = [c for c in rows.columns if keep_text or c != "text"]
    schema = rows.select(names).schema.add("bad", "double").add("toxic", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                x = features(data, offsets, model.lexicon)
                ratio = [pa.array(np.clip(x[:, t] @ model.weights[t] - model.prior[t], -20, 20)) for t in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *ratio], names=[*names, "bad", "toxic"])

    return rows.mapInArrow(run, schema)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, model: Model) -> DataFrame:
    """(site_host, site_path, host_good, path_good, counted) of scored (host, path, bad): posterior shares of good documents, by
    grouped aggregation, and what they are made of.

    A document counts as good by its own probability. Hosts are shrunk toward the corpus share, and paths toward
    their host's posterior, by prior strengths estimated from the spread between hosts and between paths:
    the wider the spread beyond chance, the weaker the prior. A site of few rows stays near its prior.
    """
    good = _sigmoid(-(F.col("bad") + F.lit(model.prior[0])))
    leaves = materialised(scored.groupBy(F.col("host").alias("site_host"), F.col("path").alias("site_path")).agg(F.count("*").alias("n"), F.sum(good).alias("g")))
    hosts = leaves.groupBy("site_host").agg(F.sum("n").alias("host_n"), F.sum("g").alias("host_g"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_g"), F.count("*"), F.sum(F.col("host_g") * F.col("host_g") / F.col("host_n"))).first()
    n, g, n_hosts, squares = (float(x or 0) for x in total)
    share = (g + 1) / (n + 2)

    def strength(squares: float, sites: float) -> float:
        spread = squares / n - share * share - share * (1 - share) * sites / n if n else 0.0
        return min(1e4, max(2.0, share * (1 - share) / spread - 1)) if spread > 1e-9 else 1e4

    m_host = strength(squares, n_hosts)
    inner = leaves.agg(F.count("*"), F.sum(F.col("g") * F.col("g") / F.col("n"))).first()
    m_path = strength(float(inner[1] or 0), float(inner[0]))
    hosts = hosts.withColumn("host_good", (F.col("host_g") + F.lit(m_host * share)) / (F.col("host_n") + F.lit(m_host)))
    joined = leaves.join(hosts.select(F.col("site_host").alias("h"), "host_good", "host_n", "host_g"), F.col("site_host").eqNullSafe(F.col("h"))).drop("h")
    counted = F.struct("n", "g", "host_n", "host_g", F.lit(m_path).alias("m_path"), F.lit(m_host).alias("m_host"), F.lit(share).alias("share")).alias("counted")
    return joined.select("site_host", "site_path", "host_good", ((F.col("g") + F.lit(m_path) * F.col("host_good")) / (F.col("n") + F.lit(m_path))).alias("path_good"), counted)


def judge(scored: DataFrame, sites: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds host_good, path_good, p_quality, p_toxic and keep to scored rows (host, path, bad, toxic). A document's prior is the
    posterior of its site's other documents: its own evidence counts once."""
    at = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    own, c = _sigmoid(-(F.col("bad") + F.lit(model.prior[0]))), F.col("counted")
    host_rest = (c["host_g"] - own + c["m_host"] * c["share"]) / (c["host_n"] - 1 + c["m_host"])
    path_rest = (c["g"] - own + c["m_path"] * host_rest) / (c["n"] - 1 + c["m_path"])
    p_quality = _sigmoid(_logit(path_rest) - F.col("bad"))
    p_toxic = _sigmoid(F.col("toxic") + F.lit(model.prior[1]))
    out = scored.join(sites, at).withColumns({"p_quality": p_quality, "p_toxic": p_toxic})
    return out.withColumn("keep", (F.col("p_quality") >= threshold) & (F.col("p_toxic") < threshold))


def classify(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Adds host_good, path_good, p_quality, p_toxic and keep to every row (columns of those names are replaced).

    keep: the posterior of good quality is at least one half and that of toxicity below it. `path` is the level
    under `host`. Null hosts or paths are sites of their own; null and empty texts have only their site's and
    the intercept's evidence; repeated rows are judged alike; an empty table gives an empty result; without
    usable labels every row has the evidence 0. columns: those of documents to carry (default: all); without the text
    among them, texts are read once besides the fit, as their evidence is written and used for sites and rows.
    """
    bound_batches(documents.sparkSession)
    added = ("host_good", "path_good", "p_quality", "p_toxic", "keep")
    model = fit(documents, labels, text, key)
    carried = list(dict.fromkeys(columns)) if columns is not None else documents.columns
    kept = documents.select(*[named(c) for c in dict.fromkeys([*carried, host, path, text])])
    used = {"host": host, "path": path, "text": text}
    held = hold(kept, used)
    if text in carried:
        scored = evidence(held, model, keep_text=True)
        sites = materialised(posteriors(evidence(held.select("host", "path", "text"), model, keep_text=False), model))
    else:
        scored = materialised(evidence(held, model, keep_text=False))
        sites = materialised(posteriors(scored, model))
    if sites.count() <= BROADCAST_SITES:  # else rows and sites are shuffled
        sites = F.broadcast(sites)
    return release(judge(scored, sites, model), kept.select(*[named(c) for c in carried]), used, {c: F.col(c) for c in added})

"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line with a word is one position of the chain. Its score comes from a few byte statistics, the chain
adds a score for each change of label, and Viterbi decoding picks the best labelling of the whole text. The
share of word characters in content lines decides whether the text stays.

The weights are fitted by maximum likelihood on all lines of a bounded sample of labelled texts (``max_docs``). Lines
carry no labels of their own, so the sample is labelled by distant supervision: lines of texts marked bad, and lines
that a share ``shared`` of all different texts of the table has, are boilerplate.

Defined results: a null or empty text has no words and fails; repeated rows get equal results; an empty table
gives an empty result; without labels of both kinds the weights are ``PRIOR``. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.session import staged

FEATURES = ("bias", "log_words", "symbols", "marks", "upper", "digits", "repeated", "distinct", "stop")
# Subtracted from each line's score for boilerplate: losing content costs more than keeping boilerplate.
CAUTION = 0.7
# Scores of boilerplate over content where nothing can be learned; then both transitions.
PRIOR = {"emit": [-1.5, -0.3, 30.0, 10.0, 4.0, 2.0, 2.0, -1.0, -0.5], "move": [[0.5, -0.5], [-0.5, 0.5]]}

REPORT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
          "n_content_lines long, content_share double, base_failed boolean, kept boolean")
_SYMBOLS, _MARKS = b"#*$%&|<>", b"!?{}[]=+~^@\\/_"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def _line_features(lines: list[bytes]) -> np.ndarray:
    """A row of ``FEATURES`` for each line of one text."""
    out, seen = np.empty((len(lines), len(FEATURES))), set()
    for i, line in enumerate(lines):
        words, size = line.split(), len(line)
        out[i] = (
            1.0, np.log1p(len(words)),
            (size - len(line.translate(None, _SYMBOLS))) / size, (size - len(line.translate(None, _MARKS))) / size,
            (size - len(line.translate(None, _UPPER))) / size, (size - len(line.translate(None, _DIGITS))) / size,
            line in seen, len(set(words)) / len(words), words[-1][-1:] in b".,;:",
        )
        seen.add(line)
    return out


def _repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur at least twice (windows compared by 64-bit hashes)."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (h[:-2] >> np.uint64(29))) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + h[2:]
    in_order = np.sort(key)
    again = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(again):
        return 0
    again = np.unique(again)
    hit = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(hit)] |= hit
    return int(covered.sum())


def decode(emit: np.ndarray, move: list[list[float]]) -> list[int]:
    """Viterbi: the best labels (1 boilerplate, 0 content); ``emit`` is the score of 1 over 0. Ties: content."""
    (stay0, to1), (to0, stay1) = move
    best0, best1, back = 0.0, 0.0, []
    for i, e in enumerate(emit.tolist()):
        if i:
            from0, from1 = best1 + to0 > best0 + stay0, best1 + stay1 > best0 + to1
            back.append((from0, from1))
            best0, best1 = (best1 + to0 if from0 else best0 + stay0), (best1 + stay1 if from1 else best0 + to1)
        best1 += e
    labels = [int(best1 > best0)] if len(emit) else []
    for step in reversed(back):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def _report(text: str | None, model: dict, min_words: int, max_repeat: int, min_share: float) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text or "") - (len(raw) - sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = _repeated_words(words)
    failed = n < min_words or 100 * repeat > max_repeat * n
    if not lines:
        return n, word_chars, 0, 0, repeat, 0, 0, 0.0, failed, False
    labels = decode(_line_features(lines) @ np.asarray(model["emit"]) - CAUTION, model["move"])
    sizes = [len(x) for x in lines]
    share = sum(s for s, y in zip(sizes, labels, strict=True) if not y) / sum(sizes)
    return (n, word_chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines),
            len(lines) - sum(labels), share, failed, not failed and share >= min_share)


def report(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
           max_repeat: int = 50, min_share: float = 0.25) -> DataFrame:
    """One row per text: its id and the columns of ``REPORT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in REPORT.split(", ")]
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        types = [kinds[x.split()[1]] for x in REPORT.split(", ")]
        for batch in batches:
            rows = [_report(x.as_py(), model, min_words, max_repeat, min_share) for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {REPORT}")


def keeps(text: Column, model: dict, min_words: int = 50, max_repeat: int = 50, min_share: float = 0.25) -> Column:
    """The same verdict as a condition, to filter rows whatever other columns they have."""

    @F.arrow_udf("boolean")
    def verdict(texts: pa.Array) -> pa.Array:
        return pa.array([_report(x.as_py(), model, min_words, max_repeat, min_share)[-1] for x in texts], type=pa.bool_())

    return verdict(text)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_chain(rows: np.ndarray, labels: np.ndarray, lengths: list[int], steps: int = 80, rate: float = 0.5,
              penalty: float = 1e-3) -> dict:
    """Maximum-likelihood weights of the chain; texts are laid out one after the other."""
    ends = np.cumsum(lengths)
    starts, longest = ends - lengths, max(lengths)
    at = starts[:, None] + np.arange(longest)[None, :]
    live = np.arange(longest)[None, :] < np.asarray(lengths)[:, None]
    at = np.where(live, at, 0)
    scale = np.maximum(np.sqrt((rows ** 2).mean(axis=0)), 1e-3)
    x, y = (rows / scale)[at] * live[..., None], labels[at] * live
    onehot = np.stack([1 - y, y], axis=-1) * live[..., None]
    pairs = (onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum(axis=(0, 1))
    weight, move, n = np.zeros(rows.shape[1]), np.zeros((2, 2)), live.sum()
    speed_w, speed_m = np.zeros_like(weight), np.zeros_like(move)
    for _ in range(steps):
        score = np.stack([np.zeros(x.shape[:2]), x @ weight], axis=-1)
        ahead, after = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(live[:, t, None], score[:, t] + _log_sum(ahead[:, t - 1, :, None] + move, 1), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(move + (score[:, t + 1] + after[:, t + 1])[:, None, :], 2)
            after[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        total = _log_sum(ahead[:, -1], 1)
        belief = np.exp(ahead + after - total[:, None, None]) * live[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + move + (score[:, 1:] + after[:, 1:])[:, :, None, :] - total[:, None, None, None])
        joint = (joint * live[:, 1:, None, None]).sum(axis=(0, 1))
        slope_w = ((onehot - belief)[..., 1][..., None] * x).sum(axis=(0, 1)) / n - penalty * weight
        slope_m = (pairs - joint) / n - penalty * move
        speed_w, speed_m = 0.9 * speed_w + slope_w, 0.9 * speed_m + slope_m
        weight, move = weight + rate * speed_w, move + rate * speed_m
    return {"emit": (weight / scale).tolist(), "move": move.tolist()}


def common_lines(docs: DataFrame, text_col: str, share: float, least: int = 3) -> DataFrame:
    """Rows (line), the hashes of lines that at least ``share`` of all different texts hold, and no fewer than ``least`` texts."""
    split = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("text"), F.explode(F.split(text_col, "\n")).alias("line"))
    held = split.select("text", F.regexp_replace("line", r"[\x20\x09-\x0D]+$", "").alias("line")).where("line <> ''").select(
        "text", F.xxhash64("line").alias("line")).distinct()
    texts = docs.select(F.xxhash64(text_col)).distinct().count()
    return held.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(least, share * texts)).select("line")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_docs: int = 1000, piece: int = 256, shared: float = 0.008) -> dict:
    """Weights fitted on all lines of the ``max_docs`` labelled texts with the smallest hashes; ``PRIOR`` without both labels.

    A line of a good text counts as boilerplate if it is common among all texts of ``docs``. Chains of more than ``piece`` lines are
    laid out in pieces of that length.
    """
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col)
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(7), id_col), id_col).limit(max_docs)
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+$", "") != "")
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(marked), id_col)
    sample = staged(texts.select(F.col(id_col).cast("string").alias("id"), "label", lines.alias("lines")).where(F.size("lines") > 0))
    hashes = F.transform("lines", lambda x: F.xxhash64(F.regexp_replace(x, r"[\x20\x09-\x0D]+$", "")))
    asked = sample.select(F.explode(hashes).alias("line")).distinct()
    common = {r["line"] for r in common_lines(docs, text_col, shared).join(asked, "line", "left_semi").collect()}  # of the sample alone
    got = sample.select("id", "label", "lines", hashes.alias("hashes")).collect()
    got = list({r["id"]: r for r in sorted(got, key=lambda r: (r["id"], r["hashes"]))}.values())
    if len({r["label"] for r in got}) < 2:
        return PRIOR
    x, y, lengths = [], [], []
    for r in got:
        x.append(_line_features([line.encode("utf-8", "surrogatepass") for line in r["lines"]]))
        y += [1.0 if r["label"] == 0 or h in common else 0.0 for h in r["hashes"]]
        lengths += [min(piece, len(r["hashes"]) - i) for i in range(0, len(r["hashes"]), piece)]
    return fit_chain(np.concatenate(x), np.array(y), lengths)

"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding: every match of the split pattern is a word. The distinct words of a partition become rows
(word, position, token), first one per byte. A recursive query joins neighbouring rows with the merge table and
contracts the leftmost pair of least rank of every word until no pair is left. Repeats of that pair further right
in the word are contracted in the same round where this can't change the outcome: no merge of the new token may
have a lower rank than the token itself. Rounds are run in bounded numbers, so a very long word is continued from
its last state and its history is not kept.

Decoding: rows (text, position, token) join the vocabulary, an aggregation ordered by position concatenates bytes.

Words are encoded in batches of bounded size and remembered up to ``memory_words`` per task; texts are processed
in groups of bounded size. The rank file is read on the driver and travels with the task (a vocabulary is bounded
by its own size, not by the data).

Defined results: a null or empty text has no tokens; repeated rows give repeated results; an empty table gives an
empty result. Texts are encoded whole; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SHORT_BYTES = 64

# Short words: one pair in each round; a row knows its right neighbour, so no window is needed.
_SHORT = """
WITH RECURSIVE t(word, pos, tok, nxt, step) AS (
  SELECT word, pos, tok, nxt, 0 FROM start
  UNION ALL
  SELECT t.word, CASE WHEN t.pos > b.at THEN t.pos - 1 ELSE t.pos END,
    CASE WHEN t.pos = b.at THEN b.merged ELSE t.tok END,
    CASE WHEN t.pos = b.at THEN b.after WHEN t.pos = b.at - 1 THEN b.merged ELSE t.nxt END, t.step + 1
  FROM t JOIN (
    SELECT low.word, low.at, low.merged, r.nxt AS after FROM (
      SELECT word, CAST(least & 4294967295 AS INTEGER) AS at, CAST(least >> 32 AS INTEGER) AS merged FROM (
        SELECT t.word, min(m.rank + t.pos) AS least
        FROM t JOIN pairs m ON t.tok::BIGINT * 4294967296 + t.nxt = m.pair GROUP BY t.word)) low
    JOIN t r ON r.word = low.word AND r.pos = low.at + 1) b ON t.word = b.word
  WHERE t.pos <> b.at + 1
)
SELECT t.word, t.pos, t.tok FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step)
ORDER BY t.word, t.pos
"""

# Long words: all repeats of the pair that allow it, in a bounded number of rounds.
_ROUNDS = """
WITH RECURSIVE t(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN chosen THEN merged ELSE tok END, step + 1 FROM (
    SELECT *, lag(chosen, 1, false) OVER (PARTITION BY word ORDER BY pos) AS absorbed FROM (
      SELECT *, coalesce(merged = low AND (
        pos = first OR NOT early AND (tok <> nxt OR (idx - run) % 2 = 0)), false) AS chosen FROM (
        SELECT *, min(merged) OVER (PARTITION BY word) AS low,
          min_by(pos, (merged, pos)) OVER (PARTITION BY word) AS first FROM (
          SELECT n.*, m.merged, m.early FROM (
            SELECT *, max(CASE WHEN prev IS DISTINCT FROM tok THEN idx END)
              OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (
              SELECT word, pos, tok, step, lead(tok) OVER w AS nxt, lag(tok) OVER w AS prev, row_number() OVER w AS idx
              FROM t WINDOW w AS (PARTITION BY word ORDER BY pos))
          ) n LEFT JOIN merges m ON n.tok = m.l AND n.nxt = m.r))
      WHERE low IS NOT NULL))
  WHERE NOT absorbed AND step < {rounds}
)
SELECT word, pos, tok, step FROM t QUALIFY step = max(step) OVER (PARTITION BY word) ORDER BY word, pos
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """The merge table and vocabulary in a DuckDB connection of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, rounds: int = 24, batch_words: int = 50_000,
                 memory_words: int = 600_000):
        import duckdb

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.batch_words, self.memory_words, self.rounds = batch_words, memory_words, rounds
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known: dict[str, bytes] = {}  # ids of 4 bytes each
        parts = [(ranks[a], ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token))
                 if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        least: dict[int, int] = {}
        for left, right, merged in parts:
            for part in (left, right):
                least[part] = min(least.get(part, merged), merged)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '500MB'; SET temp_directory = ''")
        left, right, merged = (pa.array(x, type=pa.int32()) for x in zip(*parts, strict=True))
        early = pa.array([least.get(m, m + 1) < m for _, _, m in parts])
        self._table("merges", pa.table({"l": left, "r": right, "merged": merged, "early": early}))
        self.db.execute("CREATE TABLE pairs AS SELECT l::BIGINT * 4294967296 + r AS pair, merged::BIGINT << 32 AS rank FROM merges")
        self._table("vocabulary", pa.table({"tok": pa.array(list(ranks.values()), type=pa.int32()),
                                            "hex": [token.hex() for token in ranks]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[str], long: bool) -> Iterator[tuple[str, bytes]]:
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        while len(word):
            nxt = np.where(np.append(word[1:], -1) == word, np.append(tok[1:], -1), -1).astype(np.int32)
            self._table("start", pa.table({"word": word, "pos": pos, "tok": tok, "nxt": nxt}))
            got = self.db.execute(_ROUNDS.format(rounds=self.rounds) if long else _SHORT).fetchnumpy()
            word, pos, tok = (np.asarray(got[c]) for c in ("word", "pos", "tok"))
            done = np.asarray(got["step"]) < self.rounds if long else np.ones(len(word), dtype=bool)
            ends = np.flatnonzero(np.diff(word[done], append=-1)) + 1
            ids, names = tok[done].astype("<i4").tobytes(), word[done][ends - 1].tolist() if len(ends) else []
            begin = 0
            for name, end in zip(names, (4 * ends).tolist(), strict=True):
                yield words[name], ids[begin:end]
                begin = end
            word, pos, tok = word[~done], pos[~done], tok[~done]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known) > self.memory_words:
            self.known = {}
        new = list(set().union(*split).difference(self.known))
        short, long = [], []
        for w in new:
            raw = w.encode()
            if (rank := self.ranks.get(raw)) is not None:  # a word of the vocabulary is one token, however it would merge
                self.known[w] = rank.to_bytes(4, "little")
            else:
                (short if len(raw) <= SHORT_BYTES else long).append(w)
        for words in (short, long):
            for at in range(0, len(words), self.batch_words):
                self.known.update(self._contract(words[at:at + self.batch_words], words is long))
        known = self.known
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<i4") for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence of token ids."""
        sizes = [len(x) for x in ids]
        self._table("tokens", pa.table({"text": np.repeat(np.arange(len(ids)), sizes), "pos": np.arange(sum(sizes)),
                                        "tok": np.concatenate([*ids, np.zeros(0, np.int32)])}))
        rows = self.db.execute("SELECT text, string_agg(hex, '' ORDER BY pos) FROM tokens JOIN vocabulary USING (tok) "
                               "GROUP BY text").fetchall()
        out = [b""] * len(ids)
        for text, digits in rows:
            out[text] = bytes.fromhex(digits)
        return out


def _groups(texts: list[str], size: int) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               group_chars: int = 2_000_000) -> DataFrame:
    """Rows (id, ids, decoded) by encoding every text and decoding its ids."""
    ranks = read_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            at = 0
            for texts in _groups([t or "" for t in batch.column(1).to_pylist()], group_chars):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(ids, type=pa.list_(pa.int32())),
                     pa.array(codec.decode(ids), type=pa.binary())], [id_col, "ids", "decoded"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")

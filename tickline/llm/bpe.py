"""Byte-level BPE by recursive DuckDB queries, one database a task.

A task cuts its texts by the split pattern and keeps the distinct pieces. A recursive query holds a row for each
token and its position; every step joins neighbouring tokens to the merge table and contracts the leftmost pair of
the least rank, until no pair is left. Decoding is an ordered aggregation over the documents' positions, joined to
the token bytes. What a task has encoded is kept, up to a bound, for its later batches.

For pieces of more than ``SHORT`` bytes the query's step also contracts the other pairs that the leftmost rule is
bound to contract later, so that a piece of a million bytes takes few steps. Tokens only grow, so what may become of a pair's neighbours is known beforehand:
a merge of a token with something that ends (begins) in its left (right) neighbour. Where every such merge has a
higher rank than the pair itself, the pair goes at once. So do the other places of the least pair, where the token
made cannot join its own neighbours at a lower rank. Where no merge at all can cross the border of two tokens,
the rows are told apart, and each side goes on by itself.

Cases: null and empty texts have no tokens (the hash of nothing); special tokens' names are ordinary text;
repeated rows get equal results; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickline.llm.common import Memo, slices

KEEP = 250_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a rank file (base64 token, rank)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def merge_table(tokens: list[bytes]) -> pa.Table:
    """Every way in which two tokens join to a third: ``pair`` of left and right, ``made`` (the third's rank, which is its id)."""
    rank = {t: i for i, t in enumerate(tokens)}
    rows = [(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
    left, right, made = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    return pa.table({"pair": left << 20 | right, "made": made.astype(np.int32)})


def neighbour_table(tokens: list[bytes]) -> pa.Table:
    """A row for every two neighbouring tokens which a merge may join, now or when they have grown.

    ``pair`` is left and right token, ``made`` what they join to now, if they do.
    ``left_least`` is the least rank of a merge of the right token with one that ends in the left token;
    ``right_least`` that of a merge of the left token with one that begins with the right token.
    """
    rank = {t: i for i, t in enumerate(tokens)}
    merges = merge_table(tokens)
    own, made = merges["pair"].to_numpy(), merges["made"].to_numpy().astype(np.int64)
    left, right = own >> 20, own & 0xFFFFF
    ends, begins = ([[rank[q] for q in cut(t) if q in rank] for t in tokens] for cut in (lambda t: [t[i:] for i in range(len(t))], lambda t: [t[: i + 1] for i in range(len(t))]))

    def each(ids: np.ndarray, parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Every part of every id, and which id it is of."""
        n = np.array([len(x) for x in parts])
        of = np.repeat(np.arange(len(ids)), n[ids])
        first = np.repeat((np.cumsum(n) - n)[ids] - np.cumsum(n[ids]) + n[ids], n[ids])
        return np.array([x for own in parts for x in own], np.int64)[first + np.arange(len(of))], of

    def least(pair: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((value, pair))
        first = np.flatnonzero(np.diff(pair[by], prepend=-1))
        return pair[by][first], value[by][first]

    (x, i), (y, j) = each(left, ends), each(right, begins)
    both, of = each(right[i], begins)
    pair = np.unique(x[of] << 20 | both)
    out = {"pair": pa.array(pair)}
    for name, (key, value) in {"made": (own, made), "left_least": least(x << 20 | right[i], made[i]), "right_least": least(left[j] << 20 | y, made[j])}.items():
        column, known = np.zeros(len(pair), np.int32), np.zeros(len(pair), bool)
        at = np.searchsorted(pair, key)
        column[at], known[at] = value, True
        out[name] = pa.array(column, mask=~known)
    return pa.table(out)


#: Positions stay dense within a piece. Pieces without a pair to contract leave the recursion with turn -1.
ENCODE = """
WITH RECURSIVE work(turn, piece, pos, id) AS (
    SELECT 0, piece, pos, id FROM start
    UNION ALL
    SELECT CASE WHEN best IS NULL THEN -1 ELSE turn + 1 END, piece,
           CASE WHEN pos > best % 4294967296 THEN pos - 1 ELSE pos END,
           CASE WHEN pos = best % 4294967296 THEN (best // 4294967296)::INTEGER ELSE id END
    FROM (
        SELECT turn, piece, pos, id, min(made::BIGINT * 4294967296 + pos) OVER (PARTITION BY piece) AS best
        FROM (
            SELECT turn, piece, pos, id, id::BIGINT * 1048576 + lead(id) OVER (PARTITION BY piece ORDER BY pos) AS pair
            FROM work WHERE turn >= 0
        ) LEFT JOIN merges USING (pair)
    )
    WHERE best IS NULL OR pos <> best % 4294967296 + 1
)
SELECT piece, list(id ORDER BY pos) AS ids FROM work WHERE turn = -1 GROUP BY piece ORDER BY piece
"""

#: The same with many pairs a step, by what ``neighbour_table`` says of the tokens beside them.
#: ``pos`` orders the tokens of all pieces, ``stretch`` is the first position of rows that may still join.
#: Stretches without a pair to contract leave the recursion with turn -1.
ENCODE_LONG = """
WITH RECURSIVE work(turn, piece, stretch, pos, id) AS (
    SELECT 0, piece, stretch, pos, id FROM start
    UNION ALL
    SELECT CASE WHEN best IS NULL THEN -1 ELSE turn + 1 END, piece, coalesce(border, stretch), pos,
           CASE WHEN made < left_least AND made < right_least OR best = made::BIGINT << 40 | pos
                    OR best >> 40 = made AND alone AND CASE WHEN id = next THEN (n - run) % 2 = 0 ELSE before IS DISTINCT FROM made END THEN made ELSE id END
    FROM (
        SELECT turn, piece, stretch, pos, id, next, n, made, alone,
               min(made::BIGINT << 40 | pos) OVER (PARTITION BY stretch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best,
               max(CASE WHEN previous IS DISTINCT FROM id THEN n END) OVER (PARTITION BY stretch ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run,
               max(CASE WHEN NOT joins THEN behind END) OVER (PARTITION BY stretch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS border,
               lag(left_least, 1, 1048576) OVER own AS left_least, lead(right_least, 1, 1048576) OVER own AS right_least, lag(made) OVER own AS before,
               coalesce(before < lag(left_least, 2, 1048576) OVER own AND before < right_least OR best = before::BIGINT << 40 | lag(pos) OVER own
                    OR best >> 40 = before AND lag(alone) OVER own AND CASE WHEN previous = id THEN (n - 1 - run) % 2 = 0 ELSE lag(made, 2) OVER own IS DISTINCT FROM before END, false) AS taken
        FROM (
            SELECT turn, piece, stretch, pos, id, previous, next, n, behind, pairs.made, coalesce(pairs.left_least, 1048576) AS left_least, coalesce(pairs.right_least, 1048576) AS right_least,
                   pairs.pair IS NOT NULL AS joins, pairs.made < coalesce(before.left_least, 1048576) AND pairs.made < coalesce(after.right_least, 1048576) AS alone
            FROM (
                SELECT turn, piece, stretch, pos, id, row_number() OVER own AS n, lead(pos) OVER own AS behind, lag(id) OVER own AS previous, lead(id) OVER own AS next, lead(id, 2) OVER own AS second
                FROM work WHERE turn >= 0 WINDOW own AS (PARTITION BY stretch ORDER BY pos)
            )
            LEFT JOIN pairs ON pairs.pair = id::BIGINT << 20 | next
            LEFT JOIN pairs before ON before.pair = previous::BIGINT << 20 | pairs.made
            LEFT JOIN pairs after ON after.pair = pairs.made::BIGINT << 20 | second
        ) WINDOW own AS (PARTITION BY stretch ORDER BY pos)
    )
    WHERE NOT taken
)
SELECT piece, list(id ORDER BY pos) AS ids FROM work WHERE turn = -1 GROUP BY piece ORDER BY piece
"""

#: Token bytes are text here, a character for each byte.
DECODE = """
SELECT doc, string_agg(bytes, '' ORDER BY pos) AS bytes
FROM tokens JOIN vocabulary USING (id)
GROUP BY doc
"""

EMPTY = hashlib.sha256(b"").hexdigest()
SHORT = 32
PIECES_A_QUERY, BYTES_A_QUERY, IDS_A_QUERY = 60_000, 1_000_000, 700_000


class Encoder:
    """One task's database, and the ids of the pieces it has met (up to ``keep``).

    ``part`` makes the queries so many times smaller, and with them the memory that they take.
    """

    def __init__(self, path: str, pattern: str, keep: int = KEEP, part: int = 1):
        import duckdb
        import regex

        self.keep = keep
        self.most_pieces, self.most_bytes, self.most_ids = (n // part for n in (PIECES_A_QUERY, BYTES_A_QUERY, IDS_A_QUERY))
        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("given", merge_table(self.tokens))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": np.arange(len(self.tokens), dtype=np.int32), "bytes": [t.decode("latin-1") for t in self.tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.has_neighbours = False
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        self.row = Memo(self._number, 1 << 62)
        self.ids, self.ends = np.zeros(1 << 20, np.int32), np.zeros(1, np.int64)

    def _number(self, piece: str) -> int:
        self.new.append(piece)
        return len(self.row)

    def _learn(self, pieces: list[bytes], long: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        if long and not self.has_neighbours:
            self.db.register("given", neighbour_table(self.tokens))
            self.db.execute("CREATE TABLE pairs AS SELECT * FROM given")
            self.has_neighbours = True
        n = np.array([len(d) for d in pieces])
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        first = np.repeat(np.cumsum(n) - n, n).astype(np.int32)
        start = pa.table({"piece": np.repeat(np.arange(len(n), dtype=np.int32), n), "stretch": first, "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
        self.db.register("given", start)
        self.db.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT * FROM given")
        got = self.db.sql(ENCODE_LONG if long else ENCODE).to_arrow_table().column("ids").combine_chunks()
        return got.flatten().to_numpy(), np.diff(got.offsets.to_numpy())

    def _learn_new(self) -> None:
        """Encode the new pieces, in queries of bounded size (a longer piece alone), and keep their ids."""
        data = [p.encode("utf-8", "surrogatepass") for p in self.new]
        new, at = np.zeros(len(data), np.int64), []
        for long in (False, True):
            some, total = [], 0
            for i, d in enumerate(data):
                if (len(d) > SHORT) != long:
                    continue
                if some and (len(some) >= self.most_pieces or total + len(d) > self.most_bytes):
                    at.append((some, *self._learn([data[k] for k in some], long)))
                    some, total = [], 0
                some.append(i)
                total += len(d)
            if some:
                at.append((some, *self._learn([data[k] for k in some], long)))
        for some, _, sizes in at:
            new[some] = sizes
        used = int(self.ends[-1])
        self.ends = np.concatenate([self.ends, used + np.cumsum(new)])
        while self.ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        for some, ids, sizes in at:
            to = np.cumsum(sizes)
            self.ids[np.repeat(self.ends[len(self.row) - len(data) + np.array(some)] - to + sizes, sizes) + np.arange(len(ids))] = ids
        self.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.row) > self.keep:
            self.forget()
        rows = []
        for t in texts:
            pieces = self.split(t)
            rows.append(np.fromiter(map(self.row.__getitem__, pieces), np.int32, len(pieces)))
        self._learn_new()
        out = []
        for row in rows:
            n = self.ends[row + 1] - self.ends[row]
            to = np.cumsum(n)
            out.append(self.ids[np.repeat(self.ends[row] - to + n, n) + np.arange(to[-1] if len(to) else 0)])
        return out

    def decoded_hashes(self, ids: list[np.ndarray]) -> list[str]:
        """SHA-256 of each id sequence's bytes, which the database puts together in order, some sequences a query."""
        if len(ids) > 1 and sum(map(len, ids)) > self.most_ids:
            return self.decoded_hashes(ids[: len(ids) // 2]) + self.decoded_hashes(ids[len(ids) // 2 :])
        n = np.array([len(x) for x in ids])
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
        tokens = pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), n), "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
        self.db.register("tokens", tokens)
        out = [EMPTY] * len(ids)
        got = self.db.sql(DECODE).to_arrow_table()
        for doc, text in zip(got.column("doc").to_pylist(), got.column("bytes"), strict=True):
            out[doc] = hashlib.sha256(text.as_py().encode("latin-1")).hexdigest()
        return out

    def id_hash(self, ids: np.ndarray) -> str:
        return hashlib.sha256(" ".join(map(self.names.__getitem__, ids.tolist())).encode()).hexdigest()


@cache
def encoder(path: str, pattern: str, keep: int = KEEP, part: int = 1) -> Encoder:
    """This Python worker's encoder; later tasks of the worker use it too."""
    return Encoder(path, pattern, keep, part)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and token ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048, 8_000_000):
                ids = encoder(path, pattern).encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_digests(docs: DataFrame, path: str, pattern: str, keep: int = KEEP, part: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids.

    ``keep`` bounds the pieces that a worker keeps (about 250 bytes each), not what it encodes; ``part`` makes its queries smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 2048, 8_000_000):
                own = encoder(path, pattern, keep, part)
                ids = own.encode([t or "" for t in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([own.id_hash(x) for x in ids], pa.string()), pa.array(own.decoded_hashes(ids), pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token-id files: shards of documents under a Re-Pair grammar, with random access to any document.

A shard file holds, little-endian: the magic, the counts, the rules (pairs of symbols), their expansion
lengths, one row for each document (id, first symbol, first token) and the symbols, 16 bits each. Symbols
below ``FIRST`` are token ids; the rest are rules. No symbol crosses a document's end, so a document is decoded
from its own symbols and the rules alone. Frequent pairs are replaced in rounds: each round counts the pairs of
the shard exactly, makes those near the most frequent one rules (pairs may hold earlier rules) and replaces them
from left to right, until no pair occurs ``RARE`` times or the rule numbers run out.

Shards are written by tasks over ranges of doc_id into the shared folder, under names no other attempt uses; the
manifest lists those that count. Cases: null and empty texts hold the end id alone; a null doc_id comes first;
rows of equal id are ordered by text; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickline.llm.common import give_back, shared_dir, slices, stored

MAGIC = b"TKRP0001"
FIRST, LAST, PER_ROUND, RARE = 50_257, 65_536, 5_000, 12
#: A round takes pairs that are at least this part as frequent as the most frequent one, so that rules of rules get numbers too.
NEAR_TOP = 2
SHARD_IDS = 4_000_000
#: Most tasks that read shards back; each reads its shards one after the other.
READERS = 20_000
END = 0
#: Stands behind a document's last symbol; no symbol while rules are made. Both halves of an empty place have it.
NONE, NO_PAIR = np.uint32(0xFFFF), np.uint32(0xFFFFFFFF)


SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: White space other than single spaces and line ends within a text, or no text at all.
_APART = "\\A\\z|  | \n|\n |\n\n|\\A[ \n]|[ \n]\\z|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class LibraryEncoder:
    """Whole texts by the tokenizers library, keeping what it gave for stretches between spaces.

    The split pattern never joins white space with what precedes it unless that is white space too. So where a
    text's white space is single spaces and line ends, its ids are those of its stretches, each with its space.
    A word of letters and the signs behind it are matches of their own, so words are kept without their signs and go
    through the library's merges once while they are kept. Arrow cuts a batch of texts and tells its distinct stretches and
    their words, so that Python meets each word once a batch. Texts that name a special token go through the library whole.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.merge = self.lib.model.tokenize
        self.most = most
        self.apart = "|".join([_APART, *(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values())])
        # the library's own byte alphabet, as its pre-tokenizer maps bytes
        printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = "".join(chr(b if b in printed else next(rest)) for b in range(256))
        self.line = self.lib.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """Rows 0 and on of ids, each up to its end; row 0 is empty."""
        self.words, self.others, self.signs = {}, {}, {"": 0}
        self.ids, self.ends = array("H"), array("q", [0, 0])

    def _words(self, keys: list[str]) -> list[list[int]]:
        """Words follow a space, or a line end that they begin with, or (return) begin a text: matches, so straight to the library's merges."""
        merge, alphabet = self.merge, self.alphabet
        mapped = [k if k.isascii() else charmap_decode(k.encode(), "strict", alphabet)[0] for k in keys]
        mapped = ["\u0120" + m if k.isalpha() else m[1:] for k, m in zip(keys, mapped, strict=True)]
        found = [[t.id for t in merge(m)] for m in mapped]
        for i in [i for i, k in enumerate(keys) if k[0] == "\n"]:
            found[i] = self.line + found[i]
        return found

    def _others(self, keys: list[str]) -> list[list[int]]:
        """Any other stretches; a return alone ends a text."""
        return [[END] if k == "\r" else self._sign(k[1:] if k[:1] == "\r" else k if k[:1] == "\n" else " " + k) for k in keys]

    def _sign(self, key: str) -> list[int]:
        return self.lib.encode(key, add_special_tokens=False).ids

    def _rows(self, kept: dict[str, int], keys: list[str], encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """The rows of distinct keys; those that aren't kept are encoded."""
        row = np.fromiter(map(kept.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(row < 0)
        if len(new):
            first, names = len(self.ends) - 1, [keys[i] for i in new.tolist()]
            row[new] = np.arange(first, first + len(new))
            kept.update(zip(names, range(first, first + len(new)), strict=True))
            found = encode(names)
            self.ends.extend(itertools.islice(itertools.accumulate(map(len, found), initial=len(self.ids)), 1, None))
            self.ids.extend(itertools.chain.from_iterable(found))
        return row

    def _stretches(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For distinct stretches the rows of their words, or of the whole where there is no word, and of the signs behind the words."""
        stems = pc.ascii_rtrim(keys, SIGNS)
        found = stems.dictionary_encode()
        stem, at = _strings(found.dictionary), found.indices.to_numpy()
        is_word = np.fromiter(map(str.isalpha, stem), bool, len(stem))
        for i in np.flatnonzero(~is_word).tolist():
            is_word[i] = stem[i][:1] in ("\n", "\r") and stem[i][1:].isalpha()
        row = np.zeros(len(stem), np.int64)
        row[is_word] = self._rows(self.words, list(itertools.compress(stem, is_word)), self._words)
        row, is_word = row[at], is_word[at]
        row[~is_word] = self._rows(self.others, _strings(keys.filter(pa.array(~is_word))), self._others)
        n, n_key = pc.binary_length(stems).to_numpy(), pc.binary_length(keys).to_numpy()
        start = np.cumsum(n_key, dtype=np.int64) - n_key + n  # a new dictionary's values lie one behind the other
        signs, to = _spans(np.frombuffer(keys.buffers()[2] or b"", np.uint8), start, np.where(is_word, n_key - n, 0))
        found = pa.StringArray.from_buffers(len(keys), pa.py_buffer(np.append(0, to).astype(np.int32)), pa.py_buffer(signs)).dictionary_encode()
        behind = self._rows(self.signs, _strings(found.dictionary), lambda new: [*map(self._sign, new)])
        return row, behind[found.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts (null: empty), each with the end id behind it, and where each text's end."""
        if len(self.words) + len(self.others) + len(self.signs) > self.most:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.apart)
        own = texts.filter(pc.invert(whole))
        parts = pc.split_pattern(pc.binary_join_element_wise("\r", pc.replace_substring(own, "\n", " \n"), " \r", ""), " ")
        words = parts.flatten().dictionary_encode()
        row = np.stack(self._stretches(words.dictionary), 1).ravel()
        ids, ends = np.frombuffer(self.ids, np.uint16), np.frombuffer(self.ends, np.int64)
        batch, to = _spans(ids, ends[row], ends[row + 1] - ends[row])
        to = np.append(0, to[1::2])  # of each stretch, word and signs
        at = words.indices.to_numpy()
        flat, to = _spans(batch, to[at], np.diff(to)[at])
        stop = to[parts.offsets.to_numpy()[1:] - 1] if len(own) else np.zeros(0, np.int64)
        if len(own) == len(texts):
            return flat, stop
        fast = iter(np.split(flat, stop[:-1]))
        out = [np.array([*self._sign(t.as_py()), END], np.uint16) if w else next(fast) for t, w in zip(texts, whole.to_pylist(), strict=True)]
        return np.concatenate(out), np.cumsum([len(x) for x in out])


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _spans(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of an array one behind the other, and where each ends."""
    to = np.cumsum(n)
    return flat[np.repeat(start - to + n, n) + np.arange(to[-1] if len(to) else 0)], to


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """This Python worker's encoder; what it keeps is bounded and serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


class Places:
    """Symbols of a shard in places that stay where they are, so that a round of rules costs what it replaces.

    ``pair`` is each place's symbol and the next one; a document's last symbol has ``NONE`` behind it. A replaced pair leaves
    its symbol at the left place; the right one is empty from then on. Neighbours are linked within a document; ``n``
    is the place beyond all documents.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.n = n = len(ids)
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        self.after[ends - 1] = n
        self.before[ends[:-1]] = n
        self.before[:1] = n
        self.pair = np.full(n + 1, NO_PAIR)
        self.pair[:n] = ids
        self.pair[:n] <<= np.uint32(16)
        self.pair[: n - 1] |= ids[1:]
        self.pair[ends - 1] |= NONE
        self.emptied: list[np.ndarray] = []

    def replace(self, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Put symbols for the pairs at ascending places that don't overlap: the pairs beside them that are no more, the new pairs and their places."""
        right, left = self.after[at], self.before[at]
        behind = self.after[right]
        more, apart = behind != self.n, left != self.n
        close = np.flatnonzero(behind[:-1] == at[1:])
        apart[close + 1] = False  # the pair between two places counts once
        left = left[apart]
        old, old_left = self.pair[right], self.pair[left]
        pair = symbols << np.uint32(16) | old & NONE
        pair[close] = symbols[close] << np.uint32(16) | symbols[close + 1]
        pair_left = old_left & ~NONE | symbols[apart]
        self.pair[at], self.pair[right], self.pair[left] = pair, NO_PAIR, pair_left
        self.after[at], self.before[behind] = behind, at
        self.emptied.append(right)
        return np.concatenate([old[more], old_left]), np.concatenate([pair[more], pair_left]), np.concatenate([at[more], left])

    def symbols(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left, and the documents' ends among them."""
        left = np.ones(self.n, bool)
        for at in self.emptied:
            left[at] = False
        return (self.pair[:-1][left] >> np.uint32(16)).astype(np.uint16), ends - np.searchsorted(np.flatnonzero(~left), ends)


def _listed(pair: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur ``RARE`` times, ascending, their counts, and their places, ascending for each pair."""
    key = pair.astype("<u8")
    key <<= np.uint64(32)
    key |= at.view(np.uint32)
    key.sort()
    pair, at = key.view("<u4")[1::2], key.view("<u4")[::2]
    first, count = _runs(pair)
    often = (count >= RARE) & (pair[first] & NONE != NONE)
    return pair[first[often]], count[often], at[np.repeat(often, count)].astype(np.int32)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
    return first, np.diff(first, append=len(ordered))


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their documents' ends, and rules (k x 2) for token ids with documents' ends (exclusive).

    Every pair's places are listed once, in the round that made its newer symbol: from then on it only loses places,
    so counts stay exact by subtracting what rounds take away, and a pair below ``RARE`` never comes back. Places of pairs
    that are no more stay in their lists until they are read. Counts of a symbol beside itself hold overlapping places,
    so such pairs are counted anew where that may matter.
    """
    doc = Places(ids, ends)
    pair, count, at = _listed(doc.pair[:-1], np.arange(doc.n, dtype=np.uint32))
    lists = [at]
    # of each pair: its count, which list has its places, where they begin there and how many there are
    table = {"pair": pair, "count": count, "list": np.zeros(len(pair), int), "from": np.cumsum(count) - count, "size": count.copy()}
    rules: list[np.ndarray] = []
    made = FIRST

    def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of these rows still stand, of overlapping places every second left out, and each place's index in rows."""
        ats, which = [np.zeros(0, np.int32)], [np.zeros(0, int)]
        of = table["list"][rows]
        for k in np.unique(of):
            mine = np.flatnonzero(of == k)
            size = table["size"][rows[mine]]
            ats.append(_spans(lists[k], table["from"][rows[mine]], size)[0])
            which.append(np.repeat(mine, size))
        at, index = np.concatenate(ats), np.concatenate(which)
        pair = table["pair"][rows]
        stands = doc.pair[at] == pair[index]
        at, index = at[stands], index[stands]
        if (twin := (pair >> np.uint32(16)) == (pair & np.uint32(0xFFFF))).any():
            same = np.flatnonzero(twin[index])
            drop = np.zeros(len(at), bool)
            drop[same] = _odd(doc.after[at[same[:-1]]] == at[same[1:]])
            at, index = at[~drop], index[~drop]
        return at, index

    while made < LAST and len(table["pair"]):
        pair, count = table["pair"], table["count"].copy()
        twins = (pair >> np.uint32(16)) == (pair & np.uint32(0xFFFF))
        top = count[~twins].max(initial=0)
        if len(near := np.flatnonzero(twins & (count >= max(RARE, top // NEAR_TOP)))):
            count[twins] = 0
            count[near] = np.bincount(places(near)[1], minlength=len(near))
        else:
            count[twins] = 0
        top = count.max()
        if top < RARE:
            break
        hot = np.flatnonzero(count >= max(RARE, top // NEAR_TOP))
        hot = hot[np.argsort(-count[hot], kind="stable")[: min(PER_ROUND, LAST - made)]]
        best, hot = hot[:1], np.sort(hot)
        hit, rule = places(hot)
        order = np.sort(hit.astype("<u8") << np.uint64(16) | rule.astype(np.uint64))  # by place
        hit, rule = (order >> np.uint64(16)).astype(np.int32), (order & np.uint64(0xFFFF)).astype(int)
        stay = ~_odd(doc.after[hit[:-1]] == hit[1:])  # of overlapping places every second goes
        hit, rule = hit[stay], rule[stay]
        used = np.bincount(rule, minlength=len(hot)) >= RARE
        if not used.any():  # neighbours took each other's places: the most frequent pair alone
            hot, used = best, np.ones(1, bool)
            hit, rule = places(hot)
        hit, rule = (x[used[rule]] for x in (hit, rule))
        gone, new, at = doc.replace(hit, (made - 1 + np.cumsum(used)).astype(np.uint32)[rule])
        rules.append(np.stack([pair[hot[used]] >> np.uint32(16), pair[hot[used]] & np.uint32(0xFFFF)], 1).astype(np.uint16))
        made += int(used.sum())
        table["count"][hot] -= np.bincount(rule, minlength=len(hot))
        gone.sort()
        first, n = _runs(gone)
        row = np.minimum(np.searchsorted(pair, gone[first]), len(pair) - 1)
        known = pair[row] == gone[first]
        table["count"][row[known]] -= n[known]
        pair, count, at = _listed(new, at)
        lists.append(at)
        more = {"pair": pair, "count": count, "list": np.full(len(pair), len(lists) - 1), "from": np.cumsum(count) - count, "size": count}
        often = table["count"] >= RARE
        table = {k: np.concatenate([v[often], more[k]]) for k, v in table.items()}
        order = np.argsort(table["pair"])
        table = {k: v[order] for k, v in table.items()}
    return *doc.symbols(ends), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)


def _odd(follows: np.ndarray) -> np.ndarray:
    """Which of places are the second, fourth, ... of a run; ``follows``: for all but the first, whether it follows the one before."""
    out = np.zeros(len(follows) + 1, bool)
    behind = np.flatnonzero(follows) + 1  # few are
    run = np.flatnonzero(np.diff(behind, prepend=-2) != 1)
    out[behind[(behind - np.repeat(behind[run], np.diff(run, append=len(behind)))) % 2 == 0]] = True
    return out


def lengths(rules: np.ndarray) -> np.ndarray:
    """Tokens that each symbol expands to."""
    out = [1] * FIRST
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out, np.int64)


class Grammar:
    """Expands symbols: every rule's expansion lies in one array, at its offset."""

    def __init__(self, rules: np.ndarray):
        parts: list[tuple] = []
        for pair in rules.tolist():
            a, b = ((x,) if x < FIRST else parts[x - FIRST] for x in pair)
            parts.append(a + b)
        self.n = np.append(np.ones(FIRST, np.int64), np.fromiter(map(len, parts), np.int64, len(parts)))
        self.at = np.cumsum(self.n) - self.n
        ids = itertools.chain.from_iterable(parts)
        self.flat = np.append(np.arange(FIRST, dtype=np.uint16), np.fromiter(ids, np.uint16, int(self.n[FIRST:].sum())))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return _spans(self.flat, self.at[symbols], self.n[symbols])[0]


def to_bytes(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> bytes:
    symbols, to, rules = compress(ids, ends)
    first = np.concatenate([[0], to[:-1]]).astype("<i8")
    token = np.concatenate([[0], ends[:-1]]).astype("<i8")
    named = np.array([d is not None for d in doc_ids], "<u1")
    head = struct.pack("<8sQQQ", MAGIC, len(doc_ids), len(rules), len(symbols))
    rule_len = lengths(rules)[FIRST:].astype("<u4")
    return b"".join([head, rules.astype("<u2").tobytes(), rule_len.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), named.tobytes(), first.tobytes(), token.tobytes(), symbols.astype("<u2").tobytes()])


class Shard:
    """A shard file's content, with random access to its documents."""

    def __init__(self, data: bytes):
        magic, docs, rules, symbols = struct.unpack_from("<8sQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<8sQQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", rules * 2).reshape(-1, 2)
        self.rule_lengths = take("<u4", rules)
        self.doc_ids, self.named = take("<i8", docs), take("<u1", docs)
        self.first, self.token, self.symbols = take("<i8", docs), take("<i8", docs), take("<u2", symbols)

    def __len__(self) -> int:
        return len(self.doc_ids)

    @cached_property
    def grammar(self) -> Grammar:
        return Grammar(self.rules)

    def ids(self, i: int) -> np.ndarray:
        """One document's token ids, from its own symbols."""
        return self.grammar.expand(self.symbols[self.first[i] : self.first[i + 1] if i + 1 < len(self) else len(self.symbols)])

    def all_ids(self) -> list[np.ndarray]:
        """Every document's token ids."""
        return np.split(self.grammar.expand(self.symbols), self.token[1:])


def write(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write the shards; the manifest: part, seq, path, docs, n_ids (in order of part and seq, ids ascend)."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(folder)
        part, seq = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, sizes, total, seq
            path = f"{root}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(path) as out:
                out.write(to_bytes(names, np.concatenate(held), np.cumsum(np.concatenate(sizes))))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "docs": len(names), "n_ids": total}])
            names, held, sizes, total, seq = [], [], [], 0, seq + 1
            give_back()
            return row

        fs.create_dir(root, recursive=True)
        for batch in batches:
            for piece in slices(batch, 4096, 5_000_000, trim=False):  # the session's batches are whole pieces
                ids, ends = encoder(tokenizer).encode(piece.column(1))
                k, done = 0, 0
                while k < piece.num_rows:  # a shard ends with the document that fills it
                    n = min(int(np.searchsorted(ends, done + SHARD_IDS - total)) + 1, piece.num_rows)
                    names += piece.column(0).slice(k, n - k).to_pylist()
                    held.append(ids[done : ends[n - 1]])
                    sizes.append(np.diff(ends[k:n], prepend=done))
                    total += int(ends[n - 1]) - done
                    k, done = n, int(ends[n - 1])
                    if total >= SHARD_IDS:
                        yield flush()
        if names:
            yield flush()

    return stored(ordered.mapInArrow(run, "part long, seq long, path string, docs long, n_ids long"), "token-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with base: the ids of all shards before, in order of part and seq.

    Sums by part come first, so the one order over everything has a row for each task that wrote files; shards add
    up within their part. An empty manifest stays empty.
    """
    rows = (Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*rows)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*rows)), F.lit(0))
    return manifest.withColumn("within", within).join(parts, "part").withColumn("base", F.col("before") + F.col("within"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    shards = placed(manifest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    shard = Shard(f.read())
                ids = [x.astype("<u4") for x in shard.all_ids()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids.astype(np.int64), pa.int64(), mask=shard.named == 0),
                    pa.array(shard.token + base, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(shards.count(), READERS))
    return shards.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, folder), folder)

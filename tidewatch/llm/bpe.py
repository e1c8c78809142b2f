"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus's frequent words are encoded once and compiled into a minimal acyclic automaton with
shared suffixes, built from the sorted words one by one. Its arcs carry numbers that add up along a
word's path to the word's place in a table of id sequences. Automaton and table are flat arrays in
one file of the shared folder, which workers map into memory (a store that cannot be mapped is
read instead). A word outside the lexicon is merged pair by pair, lowest rank first, leftmost first. Both
ways give the same ids: which words are in the lexicon changes the time, never the result. For the
same reason a task reports only words that it saw ``MIN_IN_TASK`` times.

Normalising and cutting into words is done by two patterns for texts below U+0250, where they agree
with the tokenizer's own components; any other text goes through those components themselves. A worker
remembers the ids and the decoded text of words, so that a text's are joined from those of its words.

Texts are encoded whole in one narrow pass. Null and empty texts have no ids; repeated rows give
repeated rows; a null id stays null; only the named columns are read, and results are added under
names that replace equal ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

LEXICON_WORDS = 65_536
MIN_IN_TASK = 4
# Words a worker remembers before it starts anew.
MEMO = 250_000
# Longer words are not put in the lexicon.
LONGEST = 64

PLAIN = re.compile("[^\x00-ɏ]")
# Also finds those whose small letters lie beyond.
NARROW = re.compile("[^" + "".join(re.escape(c) for c in map(chr, range(0x250)) if max(c.lower()) < "\u0250") + "]")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class Tables:
    """Vocabulary, merge ranks, special tokens and word pattern of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        model = spec["model"]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if (
            model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None
            or kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or not splits[0]["invert"]
        ):
            raise ValueError(f"{path} is not a lower-case BPE with word ends")
        self.raw = raw
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Rank of a pair of ids, and the id that the pair of each rank becomes.
        self.rank = {self.ids[a] << 32 | self.ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.joined = [self.ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        # \s of the file's pattern is Unicode white space, which leaves out U+001C to U+001F.
        space = r"\t\n\x0b\x0c\r \x85\xa0"
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", space)
        self.words = regex.compile(pattern)
        # Plain texts need the classes of the first characters only, which the standard library cuts faster.
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, "".join(re.escape(c) for c in map(chr, range(0x250)) if regex.match(kind, c)))
        self.plain_words = self.words if r"\p" in pattern else re.compile(pattern)
        self.chars = byte_chars()
        #: Ids of single bytes inside a word and at its end.
        self.bytes = [self.ids[c] for c in self.chars]
        self.ends = [self.ids[c + self.end] for c in self.chars]
        self.tokens = [""] * (max(self.ids.values()) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        self._library = None

    def pieces(self, text: str) -> list[str]:
        """The words of a stretch of text without special tokens."""
        if not NARROW.search(text):
            return self.plain_words.findall(text.lower())
        if not PLAIN.search(text):
            return self.words.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.raw)
        lib = self._library
        back = {c: b for b, c in enumerate(self.chars)}
        found = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in found]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: pairs merge in order of rank, the leftmost first."""
        ids = [self.bytes[b] for b in word]
        ids[-1] = self.ends[word[-1]]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, joined = self.rank.get, self.joined
        none = len(joined)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at] = joined[best]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 32 | ids[at + 1], none)
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | ids[at], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in time that does not grow with the square of the word."""
        n, rank, joined = len(ids), self.rank, self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[k], i, k) for i, k in enumerate(a << 32 | b for a, b in zip(ids, ids[1:], strict=False)) if k in rank]
        heapq.heapify(heap)
        while heap:
            r, i, k = heapq.heappop(heap)
            j = after[i]
            # A pair that has changed since is not merged.
            if j >= n or ids[i] < 0 or ids[i] << 32 | ids[j] != k:
                continue
            ids[i], ids[j] = joined[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := ids[i] << 32 | ids[after[i]]) in rank:
                    heapq.heappush(heap, (rank[k], i, k))
            if before[i] >= 0 and (k := ids[before[i]] << 32 | ids[i]) in rank:
                heapq.heappush(heap, (rank[k], before[i], k))
        return [i for i in ids if i >= 0]


def build_automaton(words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, as flat arrays.

    State s has the arcs first[s]:first[s + 1]; an arc has a label, a target and the number of
    words of the state that come before its own. ``final`` marks states that end a word.
    """
    # A state under construction: [final, {byte: state}]; a registered state is shared by its signature.
    root: list = [False, {}]
    register: dict[tuple, list] = {}
    path: list[tuple[list, int, list]] = []
    last = b""

    def settle(upto: int) -> None:
        while len(path) > upto:
            parent, byte, child = path.pop()
            key = (child[0], tuple((b, id(t)) for b, t in child[1].items()))
            parent[1][byte] = register.setdefault(key, child)

    for word in words:
        if word <= last and last:
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        node = path[-1][2] if path else root
        for byte in word[same:]:
            child = [False, {}]
            node[1][byte] = child
            path.append((node, byte, child))
            node = child
        node[0] = True
        last = word
    settle(0)

    # Children before parents: the number of words below each state.
    order, number, below, stack = [], {}, {}, [(root, False)]
    while stack:
        node, done = stack.pop()
        if id(node) in below:
            continue
        if done:
            below[id(node)] = node[0] + sum(below[id(t)] for t in node[1].values())
            number[id(node)] = len(order)
            order.append(node)
        else:
            stack.append((node, True))
            stack += [(t, False) for t in node[1].values() if id(t) not in below]
    first, label, target, skip, final = [0], [], [], [], []
    for node in order:
        at = int(node[0])
        for byte, t in sorted(node[1].items()):
            label.append(byte)
            target.append(number[id(t)])
            skip.append(at)
            at += below[id(t)]
        first.append(len(label))
        final.append(node[0])
    return {
        "first": np.array(first, np.uint32), "label": np.array(label, np.uint8),
        "target": np.array(target, np.uint32), "skip": np.array(skip, np.uint32), "final": np.array(final, np.uint8),
    }


FIELDS = (("first", "I"), ("target", "I"), ("skip", "I"), ("ends", "I"), ("ids", "I"), ("label", "B"), ("final", "B"))


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the lengths of the seven arrays, then the arrays."""
    head = struct.pack("<8Q", 0x5457, *(len(arrays[n]) for n, _ in FIELDS))
    return head + b"".join(arrays[n].astype("<u4" if k == "I" else "u1").tobytes() for n, k in FIELDS)


class Lexicon:
    """A compiled lexicon over a memory map (or over bytes)."""

    def __init__(self, data):
        view = memoryview(data)
        lengths = struct.unpack("<8Q", view[:64])[1:]
        at = 64
        for (name, kind), n in zip(FIELDS, lengths, strict=True):
            size = n * (4 if kind == "I" else 1)
            setattr(self, name, view[at : at + size].cast(kind))
            at += size
        self.labels = bytes(self.label)

    @classmethod
    def open(cls, uri: str) -> Lexicon:
        system, path = common.file_system(uri)
        if system.type_name == "local":
            return cls(pa.memory_map(path).read_buffer())
        return cls(common.get(uri))

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None."""
        state, place = len(self.final) - 1, 0
        first, labels = self.first, self.labels
        for i in range(len(word)):
            arc = labels.find(word[i : i + 1], first[state], first[state + 1])
            if arc < 0:
                return None
            place += self.skip[arc]
            state = self.target[arc]
        if not self.final[state]:
            return None
        start = self.ends[place - 1] if place else 0
        return self.ids[start : self.ends[place]].tobytes()


class Encoder(dict):
    """Word -> its ids as bytes and their tokens, filled on demand from the lexicon or by merging."""

    def __init__(self, tables: Tables, lexicon: Lexicon | None):
        super().__init__()
        self.tables, self.lexicon = tables, lexicon

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        raw = word.encode("utf-8", "surrogateescape")
        ids = self.lexicon.find(raw) if self.lexicon else None
        if ids is None:
            numbers = self.tables.merge(raw)
            ids = struct.pack(f"<{len(numbers)}I", *numbers)
        else:
            numbers = memoryview(ids).cast("I")
        names = self.tables.tokens
        got = ids, " ".join([names[i] for i in numbers]).encode("utf-8", "surrogatepass")
        if len(self) >= MEMO:
            self.clear()
        self[word] = got
        return got

    def both(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text and its decoded text."""
        t = self.tables
        parts = t.cut.split(text) if t.cut is not None and "<|" in text else [text]
        found = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append((t.special[part].to_bytes(4, "little"), part.encode()))
            elif part:
                found += [self[w] for w in t.pieces(part)]
        return b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])

    def encode(self, text: str) -> bytes:
        return self.both(text)[0]


def frequent_words(df: DataFrame, text: str, path: str, most: int) -> list[str]:
    """The most frequent words, ``most`` at most: no more reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, seen = Tables(path), Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(tables.pieces(value.as_py() or ""))
            if len(seen) > 4 * MEMO:
                yield emit(seen)
                seen = Counter()
        yield emit(seen)

    def emit(seen: Counter) -> pa.RecordBatch:
        rows = [(w, n) for w, n in seen.items() if n >= MIN_IN_TASK and len(w) <= LONGEST and w.isprintable()]
        words = pa.array([w for w, _ in rows], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in rows], pa.int64())], ["w", "c"])

    counts = df.select(F.col(text).alias("t")).mapInArrow(count, "w string, c long")
    totals = common.stored(counts.groupBy("w").agg(F.sum("c").alias("c")))
    return [w for w, _ in common.most_frequent(totals, most)]


def build_lexicon(df: DataFrame, path: str, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``df`` into a file of the shared folder; returns its path."""
    tables = Tables(path)
    words = sorted(w.encode() for w in frequent_words(df, text, path, most))
    ids = [tables.merge(w) for w in words]
    arrays = build_automaton(words)
    arrays["ends"] = np.cumsum([len(x) for x in ids], dtype=np.int64) if ids else np.zeros(0)
    arrays["ids"] = np.array([i for x in ids for i in x], np.int64)
    uri = common.scratch(df.sparkSession, "lexicon") + ".bin"
    common.put(uri, pack(arrays))
    return uri


def encode(
    df: DataFrame, path: str, text: str = "text", lexicon: str | None = None, ids: bool = True, digests: bool = True
) -> DataFrame:
    """Adds n_tokens and, as asked, the ids and the digests of ids and of the decoded text."""
    lexicon = lexicon or build_lexicon(df, path, text)
    added = ["n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    kept = [c for c in df.columns if c not in added]
    inner = [f"_c{i}" for i in range(len(kept))]
    types = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    fields = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(inner, kept, strict=True)]
    schema = ", ".join([*fields, *(f"{c} {types[c]}" for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Tables(path), Lexicon.open(lexicon))
        for batch in batches:
            raw, names = [], []
            for x in batch.column(at_text):
                mine, decoded = encoder.both(x.as_py() or "")
                raw.append(mine)
                if digests:
                    names.append(hashlib.sha256(decoded).hexdigest())
            sizes = [len(r) // 4 for r in raw]
            arrays = [pa.array(sizes, pa.int64())]
            if ids:
                ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, flat))
            if digests:
                arrays.append(pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()))
                arrays.append(pa.array(names, pa.string()))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], [*inner, *added])

    asked, at_text = df.select(*[F.col(c).alias(n) for n, c in zip(inner, kept, strict=True)]), kept.index(text)
    return asked.mapInArrow(run, schema).toDF(*kept, *added)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = common.table(spark, folder, "documents").select("doc_id", "text")
    return encode(documents, default_path(), ids=False).drop("text")

"""Token ids in raw shard files, found by document key through a minimal perfect hash.

Texts are encoded by the tokenizers library and dealt by ranges of doc_id, so that the
shards in order hold all documents in ascending order of their ids.  A store has

* ``shard-*.bin``: the ids of a shard's documents one after another, little-endian and
  unsigned, nothing else (2 bytes an id, 4 for vocabularies over 65,536);
* ``shard-*.off``: where each of its documents begins, and the end, counted in ids;
* ``index-*.mph``: a minimal perfect hash over the keys of one part of the index, and for
  each slot the key's fingerprint, shard, place in the shard and number of rows;
* ``manifest``: files, documents and ids of the shards, the parts of the index.

A key is looked up in constant time: its part by a hash, its slot by levels of bits (a
level holds the keys that are alone at their place in it, the others go on to the next),
its fingerprint compared, then one place of ``.off`` and one of ``.bin`` read.  A task names
its files by a fresh suffix, and only those that a finished task reported are in the
manifest: files of lost or repeated tasks are never read.

Defined cases: null texts are empty, an empty text has the end id alone; rows without an id
come first and are found by the null key; rows that repeat an id stand together, ordered by
a hash of the text, and the key finds all of them, over several shards if need be; keys that
the store lacks give no rows; an empty table makes an empty store; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, shared_dir, slices

#: Appended to each document.
END = 2
#: Keys of one part of the index, on average.
PART_KEYS = 1 << 18
#: Bits of a level for each key that reaches it.
GAMMA = 2
#: Words kept in a worker, longest word kept, places of the table of words.
WORDS, LONGEST, PLACES = 1 << 20, 48, 1 << 22


# -- encoding --------------------------------------------------------------------------

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: Endings that the byte-level rule cuts off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Encoder:
    """Ids of texts as the library's byte-level tokenizers give them.

    Texts are cut into words by the library's rule, on arrays of code points; each distinct
    word is encoded by the library once and remembered, and a remembered word is compared
    letter by letter.  Texts that hold an added token go to the library whole, and so do
    all texts if the file asks for another way of cutting.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        cut = whole.get("pre_tokenizer") or {}
        self.by_words = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not whole.get("normalizer")
        self.added = [t["content"] for t in whole.get("added_tokens", []) if t["content"]]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.random = np.random.default_rng(7).integers(0, 1 << 32, 0x110000, np.uint32)
        step = np.uint32(0x9E3779B1)  # odd, so that it has an inverse
        self.up = np.cumprod(np.full((1 << 20) + 1, step, np.uint32), dtype=np.uint32)
        self.down = np.cumprod(np.full((1 << 20) + 1, np.uint32(pow(int(step), -1, 1 << 32)), np.uint32), dtype=np.uint32)
        self.forget()

    def forget(self) -> None:
        self.places = np.full(PLACES, -1, np.int32)
        self.rows, self.n_letters, self.n_ids = 0, 0, 0
        self.tag = np.zeros(WORDS, np.uint32)
        self.used = np.zeros(WORDS, bool)  # found again since it was remembered
        self.spans = np.zeros((WORDS, 4), np.int32)  # letters: begin, length; ids: begin, length
        self.letters, self.ids = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, self.kind)
        self.clashes: dict[str, int] = {}

    def _forget_rare(self) -> None:
        """Of a full memory the words stay that were met again, or none if those fill half of it."""
        keep = np.flatnonzero(self.used[: self.rows])
        old = self.letters, self.ids, self.spans, self.tag
        self.forget()
        if len(keep) and 2 * len(keep) <= WORDS:
            spans = old[2][keep].tolist()
            self._remember(["".join(map(chr, old[0][a : a + n].tolist())) for a, n, _, _ in spans], old[3][keep], [old[1][b : b + m].tolist() for _, _, b, m in spans])

    def _learn(self, code_points: np.ndarray) -> None:
        """Classes of characters, asked of the library's own rule."""
        together = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s)) == 1
        for c in np.unique(code_points).tolist():
            x = chr(c)
            self.classes[c] = LETTER if together("a" + x) else NUMBER if together("1" + x) else OTHER if together("!" + x) else SPACE

    def starts(self, cp: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where words start; begins are the first places of the texts in cp, which has no empty text."""
        kind = self.classes[cp]
        if (new := kind == UNKNOWN).any():
            self._learn(cp[new])
            kind = self.classes[cp]
        space = kind == SPACE
        first = np.zeros(len(cp), bool)
        first[begins] = True
        last = np.zeros(len(cp), bool)
        last[begins[1:] - 1] = True
        last[-1] = True
        out = np.empty(len(cp), bool)
        plain = cp == 32
        # A blank joins the word after it; other white space stands alone before one.
        out[1:] = (kind[1:] != kind[:-1]) & ~(plain[:-1] & ~space[1:])
        out[:-1] |= space[:-1] & ~space[1:] & ~last[:-1]
        out |= first
        for i in np.flatnonzero(cp == 39).tolist():
            if i and not first[i] and (kind[i - 1] == OTHER or plain[i - 1]):
                continue
            stop = i + 1
            while stop < len(cp) and stop <= i + 2 and not first[stop]:
                stop += 1
            tail = "".join(map(chr, cp[i + 1 : stop].tolist()))
            if found := next((e for e in ENDINGS if tail.startswith(e)), None):
                out[i + 1 : i + 1 + len(found)] = False
                if (j := i + 1 + len(found)) < len(cp):
                    out[j] |= first[j] or not space[j] or out[j]
        return np.flatnonzero(out)

    def _find(self, tags: np.ndarray, cp: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of remembered words, -1 for others."""
        row = np.full(len(tags), -1, np.int64)
        place, live = (tags >> np.uint32(10)).astype(np.int64), np.arange(len(tags))
        for _ in range(8):
            r = self.places[place]
            hit = (r >= 0) & (self.tag[r] == tags[live])
            row[live[hit]] = r[hit]
            on = ~hit & (r >= 0)
            live, place = live[on], (place[on] + 1) % PLACES
            if not len(live):
                break
        hit = np.flatnonzero(row >= 0)
        hit = hit[self.spans[row[hit], 1] == size[hit]]
        each = size[hit]
        ends = np.cumsum(each)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - each, each)
        same = self.letters[np.repeat(self.spans[row[hit], 0], each) + step] == cp[np.repeat(at[hit], each) + step]
        ok = np.add.reduceat(same, ends - each) == each if len(hit) else np.zeros(0, bool)
        found = np.full(len(tags), -1, np.int64)
        found[hit[ok]] = row[hit[ok]]
        self.used[row[hit[ok]]] = True
        return found

    def _remember(self, words: list[str], tags: np.ndarray, ids: list) -> np.ndarray:
        """The words' new rows; words whose tag or places are taken are found by a dictionary."""
        row = np.arange(self.rows, self.rows + len(words))
        self.rows += len(words)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        flat = np.array([i for x in ids for i in x], self.kind)
        for name, have, new in (("letters", self.n_letters, letters), ("ids", self.n_ids, flat)):
            while have + len(new) > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
            getattr(self, name)[have : have + len(new)] = new
        for k, have, sizes in ((0, self.n_letters, list(map(len, words))), (2, self.n_ids, list(map(len, ids)))):
            self.spans[row, k] = have + np.cumsum([0, *sizes[:-1]])
            self.spans[row, k + 1] = sizes
        self.n_letters += len(letters)
        self.n_ids += len(flat)
        self.tag[row] = tags
        live, place, clashes = np.arange(len(words)), (tags >> np.uint32(10)).astype(np.int64), []
        for _ in range(8):
            free = self.places[place] < 0
            self.places[place[free]] = row[live[free]]
            held = self.places[place]
            placed, same = held == row[live], self.tag[held] == tags[live]
            clashes += live[same & ~placed].tolist()
            live, place = live[~same], (place[~same] + 1) % PLACES
        self.clashes |= {words[k]: int(row[k]) for k in clashes + live.tolist()}
        return row

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each whole text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        apart = [k for k, t in enumerate(texts) if t and (not self.by_words or len(t) > 1 << 20 or any(a in t for a in self.added))]
        for k, e in zip(apart, self.library.encode_batch_fast([texts[k] for k in apart], add_special_tokens=False) if apart else [], strict=True):
            out[k] = np.array(e.ids, self.kind)
        rest = [k for k, t in enumerate(texts) if t and out[k] is None]
        i = 0
        while i < len(rest):  # runs of at most 2**18 code points, or a single text
            j, n = i, 0
            while j < len(rest) and (j == i or n + len(texts[rest[j]]) <= 1 << 18):
                n += len(texts[rest[j]])
                j += 1
            for k, ids in zip(rest[i:j], self._run([texts[k] for k in rest[i:j]]), strict=True):
                out[k] = ids
            i = j
        return [np.zeros(0, self.kind) if x is None else x for x in out]

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0] + [len(t) for t in texts[:-1]])
        at = self.starts(cp, begins)
        size = np.diff(at, append=len(cp))
        total = np.zeros(len(cp) + 1, np.uint32)
        np.cumsum(self.random[cp] * self.up[: len(cp)], dtype=np.uint32, out=total[1:])
        tags = (total[at + size] - total[at]) * self.down[at]
        tags ^= tags >> np.uint32(15)
        tags *= np.uint32(0x2C1B3C6D)
        row = self._find(tags, cp, at, size)
        missing = np.flatnonzero(row < 0)
        extra_ids, extra = [], {}
        if len(missing):
            fresh: dict[str, int] = {}
            for k, a, n in zip(missing.tolist(), at[missing].tolist(), size[missing].tolist(), strict=True):
                word = joined[a : a + n]
                if (known := self.clashes.get(word)) is not None:
                    row[k] = known
                else:
                    fresh.setdefault(word, k)
            names = list(fresh)
            made = dict(zip(names, self.library.encode_batch_fast(names, add_special_tokens=False), strict=True)) if names else {}
            if self.rows + len(names) > WORDS and self.rows:
                self._forget_rare()  # rows of this run are looked up again
                return self._run(texts)
            kept = [w for w in names if len(w) <= LONGEST][: WORDS - self.rows]
            rows = dict(zip(kept, self._remember(kept, tags[[fresh[w] for w in kept]], [made[w].ids for w in kept]).tolist(), strict=True)) if kept else {}
            for word in names:
                if word not in rows:
                    extra[word] = (len(extra_ids), len(made[word].ids))
                    extra_ids += made[word].ids
            begin, n_ids = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for k in missing[row[missing] < 0].tolist():
                word = joined[at[k] : at[k] + size[k]]
                if word in rows:
                    row[k] = rows[word]
                else:
                    begin[k], n_ids[k] = extra[word][0] + self.n_ids, extra[word][1]
        else:
            begin, n_ids = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        known = row >= 0
        begin[known], n_ids[known] = self.spans[row[known], 2], self.spans[row[known], 3]
        flat = np.concatenate([self.ids[: self.n_ids], np.array(extra_ids, self.kind)]) if extra_ids else self.ids
        stop = np.cumsum(n_ids)
        ids = flat[np.repeat(begin - (stop - n_ids), n_ids) + np.arange(int(stop[-1]))]
        first = np.searchsorted(at, begins)
        ends = np.append(stop[first[1:] - 1], stop[-1])
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- minimal perfect hash --------------------------------------------------------------


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers for each salt."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """sizes: bits of each level; words: the levels' bits; before: bits set before each word."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct 64-bit keys."""
        rest, sizes, words = np.asarray(keys, np.uint64), [], []
        while len(rest):
            size = -(-len(rest) * GAMMA // 64) * 64
            place = (_mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            n = np.bincount(place, minlength=size)
            words.append(np.packbits(n == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[n[place] > 1]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(flat).astype(np.int64)
        return cls(np.array(sizes, np.int64), flat, np.cumsum(ones) - ones)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A number below the number of keys for each key, other values may get any or -1."""
        keys = np.asarray(keys, np.uint64)
        out, live, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(live):
                break
            place = (_mix(keys[live], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[live[hit]] = self.before[place[hit] >> 6] + below
            live, base = live[~hit], base + size
        return out


#: Arrays of an index file, in order.
_INDEX = (("sizes", np.int64), ("words", np.uint64), ("before", np.int64), ("prints", np.uint32), ("shard", np.uint32), ("place", np.uint32), ("rows", np.uint64))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys, np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _pack(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(arrays), *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


def _unpack(data: bytes, kinds: list) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8 * (n + 1), []
    for kind, size in zip(kinds, np.frombuffer(data, np.int64, n, 8).tolist(), strict=True):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes + -out[-1].nbytes % 8
    return out


# -- files -----------------------------------------------------------------------------


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(uri: str, data: bytes) -> None:
    where, path = _place(uri)
    with where.open_output_stream(path) as out:
        out.write(data)


def _read(uri: str) -> bytes:
    where, path = _place(uri)
    with where.open_input_file(path) as f:
        return f.read()


@dataclass
class Store:
    """What the manifest says: shards in order of doc_id, the files of the index's parts."""

    folder: str
    width: int
    nulls: int
    files: list[str]
    docs: np.ndarray
    ids: np.ndarray
    parts: list[str]

    def save(self) -> None:
        import json

        _write(f"{self.folder}/manifest", json.dumps({**self.__dict__, "docs": self.docs.tolist(), "ids": self.ids.tolist()}).encode())

    @classmethod
    def open(cls, folder: str) -> Store:
        import json

        x = json.loads(_read(f"{folder}/manifest"))
        return cls(**x | {"docs": np.array(x["docs"], np.int64), "ids": np.array(x["ids"], np.int64)})


_stores: dict[str, Store] = {}


def _store(folder: str) -> Store:
    if folder not in _stores:
        _stores.clear()
        _stores[folder] = Store.open(folder)
    return _stores[folder]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


_WRITTEN = "doc_id long, shard int, place long, n_tokens long, file string"


def write_store(docs: DataFrame, path: str, end: int = END, folder: str | None = None) -> Store:
    """Encodes docs with the tokenizer file and writes shards, index and manifest into a new folder of spark.checkpoint.dir."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/quakeframe-tokens-{uuid.uuid4().hex}"
    where, local = _place(folder)
    where.create_dir(local, recursive=True)
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    kind = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.string())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        encoder, shard = _encoder(SparkFiles.get(name)), TaskContext.get().partitionId()
        stem, offsets, place = f"shard-{shard:05d}-{uuid.uuid4().hex[:12]}", [np.zeros(1, np.uint64)], 0
        where, local = _place(f"{folder}/{stem}.bin")
        out = None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts, 1 << 21):
                out = out or where.open_output_stream(local)
                ids = [np.append(x, encoder.kind.type(end)) for x in encoder.encode(texts[i:j])]
                out.write(np.concatenate(ids).tobytes())
                n = np.array([len(x) for x in ids], np.uint64)
                offsets.append(offsets[-1][-1] + np.cumsum(n, dtype=np.uint64))
                m = j - i
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), pa.array([shard] * m, pa.int32()), pa.array(np.arange(place, place + m)), pa.array(n.astype(np.int64)), pa.array([stem] * m)], schema=kind)
                place += m
        if out:
            out.close()
            _write(f"{folder}/{stem}.off", np.concatenate(offsets).tobytes())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    written = durable(dealt.select("doc_id", "text").mapInArrow(shards, _WRITTEN))
    made = written.groupBy("shard").agg(F.first("file").alias("file"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    made = sorted(made.collect())  # a row for each shard
    numbers = {r["shard"]: k for k, r in enumerate(made)}
    parts = max(1, -(-sum(r["docs"] for r in made) // PART_KEYS))
    store = Store(folder, _width(path), sum(r["nulls"] for r in made), [r["file"] for r in made], np.array([r["docs"] for r in made], np.int64), np.array([r["ids"] for r in made], np.int64), [""] * parts)
    dense = np.full(max(numbers, default=-1) + 1, -1, np.int64)
    dense[list(numbers)] = list(numbers.values())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            part, columns = batch.column(0).to_numpy(), [c.to_numpy() for c in batch.columns[1:]]
            for p in np.unique(part).tolist():
                found.setdefault(p, []).append([c[part == p] for c in columns])
        for p, pieces in found.items():
            key, shard, place, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
            keys = key.astype(np.int64).view(np.uint64)
            hashed = PerfectHash.build(keys)
            slot = np.argsort(hashed.slots(keys))
            arrays = [hashed.sizes, hashed.words, hashed.before, fingerprints(keys)[slot], dense[shard[slot]], place[slot], n[slot]]
            file = f"index-{p:05d}-{uuid.uuid4().hex[:12]}.mph"
            _write(f"{folder}/{file}", _pack([np.asarray(a, k) for a, (_, k) in zip(arrays, _INDEX, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([file])], names=["part", "file"])

    first = F.min(F.struct("shard", "place")).alias("first")
    keys = written.where("doc_id is not null").groupBy("doc_id").agg(first, F.count(F.lit(1)).alias("n"))
    keys = keys.select(_part(F.col("doc_id"), parts).alias("part"), "doc_id", "first.shard", "first.place", "n")
    built = durable(keys.repartitionById(parts, "part").mapInArrow(index, "part int, file string"))
    for r in built.collect():  # a row for each part
        store.parts[r["part"]] = r["file"]
    store.save()
    discard(written, built)
    return store


def _width(path: str) -> int:
    return _encoder(path).width


# -- keyed access ----------------------------------------------------------------------


def look_up(spark: SparkSession, store: Store, keys: DataFrame, column: str = "doc_id") -> DataFrame:
    """(doc_id, shard, place, rows) for the distinct keys that the store has; a key's run of rows is cut at the ends of shards."""
    folder, parts = store.folder, len(store.parts)
    kind = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("rows", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held, index = _store(folder), -1, None
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            lacks = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            key = batch.column(1).fill_null(0).to_numpy()
            shard, place, n = (np.zeros(len(key), np.int64) for _ in range(3))
            n[lacks] = store.nulls
            for p in np.unique(part[~lacks]).tolist():
                if not store.parts[p]:
                    continue
                if p != held:
                    held, index = p, _unpack(_read(f"{folder}/{store.parts[p]}"), [k for _, k in _INDEX])
                mine = np.flatnonzero((part == p) & ~lacks)
                asked = key[mine].view(np.uint64)
                slot = PerfectHash(*index[:3]).slots(asked)
                ok = (slot >= 0) & (index[3][slot] == fingerprints(asked))
                mine, slot = mine[ok], slot[ok]
                shard[mine], place[mine], n[mine] = index[4][slot], index[5][slot], index[6][slot]
            got = np.flatnonzero(n > 0)
            ids = batch.column(1).take(pa.array(got))
            shard, place, n = shard[got], place[got], n[got]
            while len(n):
                here = np.minimum(n, store.docs[shard] - place)
                yield pa.RecordBatch.from_arrays([ids, pa.array(shard.astype(np.int32)), pa.array(place), pa.array(here)], schema=kind)
                more = np.flatnonzero(n > here)
                ids, n, shard, place = ids.take(pa.array(more)), (n - here)[more], shard[more] + 1, np.zeros(len(more), np.int64)

    asked = keys.select(F.col(column).cast("long").alias("doc_id")).distinct()
    asked = asked.select(_part(F.col("doc_id"), parts).alias("part"), "doc_id").repartitionById(parts, "part")
    return asked.mapInArrow(find, "doc_id long, shard int, place long, rows long")


def _documents(folder: str, found: Iterator[tuple], digest: bool) -> Iterator[tuple]:
    """Reads runs of documents, a file open at a time."""
    store = _store(folder)
    base = np.concatenate(([0], np.cumsum(store.ids)))
    kind, held, offsets, payload = np.dtype(f"<u{store.width}"), -1, None, None
    for key, shard, place, rows in found:
        if shard != held:
            if payload:
                payload.close()
            stem = f"{folder}/{store.files[shard]}"
            where, local = _place(f"{stem}.bin")
            held, offsets, payload = shard, np.frombuffer(_read(f"{stem}.off"), np.uint64), where.open_input_file(local)
        for p in range(place, place + rows):
            a, b = int(offsets[p]), int(offsets[p + 1])
            ids = np.frombuffer(payload.read_at((b - a) * store.width, a * store.width), kind).astype("<u4")
            yield key, int(base[shard]) + a, b - a, zlib.crc32(ids.tobytes()) if digest else ids.astype(np.int64).tolist()
    if payload:
        payload.close()


def _fetch(spark: SparkSession, store: Store, keys: DataFrame, column: str, digest: bool) -> DataFrame:
    folder = store.folder
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int64()))
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, size = [], 0
        for row in _documents(folder, runs, digest):
            out.append(row)
            size += 1 if digest else row[2]
            if size >= (1 << 14 if digest else 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    runs = look_up(spark, store, keys, column).repartition("shard").sortWithinPartitions("shard", "place")
    return runs.mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def fetch(spark: SparkSession, store: Store, keys: DataFrame, column: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents that the keys name, each key once; start counts the ids of all documents before."""
    return _fetch(spark, store, keys, column, False)


def stored_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document, read back from the files by its key: doc_id, start, n_tokens, ids_crc32."""
    return _fetch(docs.sparkSession, write_store(docs, path), docs, "doc_id", True)

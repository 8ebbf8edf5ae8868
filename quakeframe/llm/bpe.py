"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words are counted over all documents, encoded exactly once on the driver, and
compiled into a minimal acyclic automaton whose arcs carry numeric outputs: the sum along
a word's path is the word's row in a table of id sequences.  The compiled arrays form one
file that Spark ships to the executors (SparkContext.addFile) and workers memory-map.  A
batch's distinct words walk the automaton together, a byte per step; words it lacks are
merged exactly and remembered in a bounded memo.  Results don't depend on the lexicon.

Words are found as the tokenizer file says: added tokens in the raw text first, then NFC,
lower case per character, the split pattern, and bytes spelled as printable characters.

Defined cases: null counts as the empty text, which has no ids and decodes to the empty
text; rows with a null doc_id are encoded; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, small_batches

MOST_WORDS, LONGEST, MEMO = 1 << 16, 40, 200_000
WORD_END = "</w>"
#: Fixed value: what the tokenizer file splits by, with \s spelled out as the White_Space property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\t-\r \x85\xa0  -     　{letter}{number}]+"


# Letters and numbers that the regex module knows from later versions of Unicode than the tokenizers' library.
LATER = (
    "՘ ֋-֌ ࢏ ౜ ೜ ₏ ₝-₟ ꟎-꟏ ꟒ ꟔ ꟝ ꟢ ꟱ ꭬-꭭ \U000107bb-\U000107bf"
    " \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f"
    " \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff"
    " \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168"
    " \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2"
    " \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead"
    " \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")
#: In turn, capitals whose lower case Python doesn't know yet.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


@cache
def _any_split() -> regex.Pattern:
    return regex.compile(SPLIT.format(letter=rf"[\p{{L}}--[{LATER}]]", number=rf"[\p{{N}}--[{LATER}]]"), regex.V1)


#: The same for text below U+0250 without the separators that Python's \s adds.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-ɏ]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 characters as they are, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and added tokens of a tokenizer file of this kind."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {p: (k, p[0] + p[1]) for k, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled = self.ids | self.added
        self.tokens = np.full(max(spelled.values(), default=-1) + 1, None, object)
        for token, i in spelled.items():
            self.tokens[i] = token
        self.letters = byte_letters()
        found = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.split_added = re.compile(f"({found})") if found else None

    def words(self, text: str) -> list:
        """The words of text; an added token is given as its id."""
        if self.split_added is None or not self.split_added.search(text):
            return _words(text)
        out: list = []
        for part in self.split_added.split(text):
            out.extend([self.added[part]] if part in self.added else _words(part))
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the pair of least rank, leftmost first, is merged until none is left."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += WORD_END
        ranks, n = self.ranks, len(parts)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = following[i]
            if parts[i] is None or j >= n or ranks.get((parts[i], parts[j]), (None,))[0] != rank:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = made, None
            following[i] = after = following[j]
            if after < n:
                before[after] = i
                if r := ranks.get((made, parts[after])):
                    heapq.heappush(heap, (r[0], i, r[1]))
            if (k := before[i]) >= 0 and (r := ranks.get((parts[k], made))):
                heapq.heappush(heap, (r[0], k, r[1]))
        return [self.ids[p] for p in parts if p is not None]

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder, so tokens are joined by spaces; unknown ids are left out."""
        found = self.tokens[ids if not len(ids) or ids.max() < len(self.tokens) else ids[ids < len(self.tokens)]].tolist()
        try:
            return " ".join(found)
        except TypeError:
            return " ".join([t for t in found if t is not None])


def _words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form, as characters are lowered alone
        if _NOT_LATIN.search(text):
            return _any_split().findall(text.translate(LOWER).lower())
    elif _NOT_LATIN.search(text):
        return _any_split().findall(text.lower())
    return _LATIN.findall(text.lower())


class Lexicon:
    """The minimal acyclic transducer: arcs sorted by state * 256 + byte, with targets and outputs."""

    FIELDS = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.uint8), ("offsets", np.int32), ("ids", np.uint32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, sequences: dict[bytes, list[int]]) -> Lexicon:
        """Adds words in order; a finished branch is replaced by an equal state met before, so suffixes are shared."""
        words = sorted(w for w in sequences if w)
        arcs: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, byte) of the last word

        def settle(depth: int) -> None:
            while len(path) > depth:
                state, byte = path.pop()
                child = arcs[state][byte]
                same = known.setdefault((final[child], tuple(arcs[child].items())), child)
                arcs[state][byte] = same

        last = b""
        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            settle(common)
            state = arcs[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte))
                state = len(arcs) - 1
            final[state] = True
            last = word
        settle(0)
        reached, order = {0: 0}, [0]
        for state in order:  # numbers in order of discovery
            for child in arcs[state].values():
                if child not in reached:
                    reached[child] = len(order)
                    order.append(child)
        below: dict[int, int] = {}  # words that end in or after a state
        stack = [0]
        while stack:
            state = stack[-1]
            todo = [c for c in arcs[state].values() if c not in below]
            if todo:
                stack.extend(todo)
                continue
            below[stack.pop()] = final[state] + sum(below[c] for c in arcs[state].values())
        keys, targets, outputs = [], [], []
        for state in order:
            skipped = int(final[state])
            for byte, child in sorted(arcs[state].items()):
                keys.append(reached[state] * 256 + byte)
                targets.append(reached[child])
                outputs.append(skipped)
                skipped += below[child]
        lists = [sequences[w] for w in words]
        values = (keys, targets, outputs, [final[s] for s in order], np.cumsum([0] + [len(x) for x in lists]), [i for x in lists for i in x])
        return cls({name: np.asarray(v, kind) for (name, kind), v in zip(cls.FIELDS, values, strict=True)})

    def save(self, path: str) -> None:
        arrays = [getattr(self, name) for name, _ in self.FIELDS]
        with open(path, "wb") as out:
            out.write(np.array([len(a) for a in arrays], np.int64).tobytes())
            for a in arrays:
                out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Maps the file: the workers of an executor share its pages."""
        whole = np.memmap(path, np.uint8, "r")
        at, arrays = 8 * len(cls.FIELDS), {}
        for (name, kind), n in zip(cls.FIELDS, whole[:at].view(np.int64), strict=True):
            size = int(n) * np.dtype(kind).itemsize
            arrays[name] = whole[at : at + size].view(kind)
            at += size + -size % 8
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The row of each word's ids, -1 for words that the lexicon lacks; all words advance together."""
        row = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        if not len(live) or not len(self.keys):
            return row
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(LONGEST):
            key = state * 256 + data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, total = self.targets[arc].astype(np.int64), total[ok] + self.outputs[arc]
            done = sizes[live] == step + 1
            ended = done & (self.final[state] == 1)
            row[live[ended]] = total[ended]
            live, state, total = live[~done], state[~done], total[~done]
            if not len(live):
                break
        return row


def frequent_words(docs: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """The commonest runs of letters over all whole texts, at most ``most`` (they only make encoding faster).

    Counts are dealt to logarithmic steps first; the steps say from which count on words
    fit, so that the driver gets those words alone, however many tasks count.
    """
    word = F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")).alias("word")
    counts = docs.select(word).where(f"word <> '' and length(word) <= {LONGEST // 2}").groupBy("word").count().where("count > 1")
    counts = durable(counts.withColumn("step", F.floor(F.log2("count") * 16).cast("int")))
    steps = counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()  # 16 a factor of two
    total, least = 0, None
    for r in steps:
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return []
    return [r["word"] for r in counts.where(F.col("step") >= least).select("word").collect()]


def build_lexicon(words: list[str], vocabulary: Vocabulary) -> Lexicon:
    spelled = {w for text in words for w in _words(text)} | {chr(b) for b in range(33, 127)}
    spelled = {w for s in spelled for w in _words(s)}
    return Lexicon.compile({w.encode(): vocabulary.merge(w) for w in spelled})


class Encoder:
    """Encodes batches of texts; kept in the worker, with a bounded memo of merged words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memo: dict[str, list[int]] = {}

    def _merged(self, word: str | int) -> list[int]:
        """Ids of a word that the lexicon lacks; an added token is its own id."""
        if isinstance(word, int):
            return [word]
        ids = self.memo.get(word)
        if ids is None:
            ids = self.vocabulary.merge(word)
            if len(word) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each whole text."""
        if not texts:
            return []
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__  # a new word gets the next number
        rows, counts = [], []
        for text in texts:
            found = self.vocabulary.words(text or "")
            counts.append(len(found))
            rows.extend(map(numbers.__getitem__, found))
        distinct = list(numbers)
        at = self.lexicon.find([w.encode() if isinstance(w, str) else b"" for w in distinct])
        offsets = self.lexicon.offsets
        begin, size = offsets[np.maximum(at, 0)].astype(np.int64), np.zeros(len(at), np.int64)
        known = at >= 0
        size[known] = offsets[at[known] + 1] - begin[known]
        merged: list[int] = []
        for i in np.flatnonzero(~known).tolist():
            ids = self._merged(distinct[i])
            begin[i], size[i] = len(self.lexicon.ids) + len(merged), len(ids)
            merged += ids
        flat = np.concatenate([self.lexicon.ids, np.array(merged, np.uint32)])
        use = np.asarray(rows, np.int64)
        each = size[use]
        stop = np.cumsum(each)
        ids = flat[np.repeat(begin[use] - (stop - each), each) + np.arange(int(stop[-1]) if len(stop) else 0)]
        ends = np.concatenate(([0], stop))[np.cumsum(counts)].tolist()
        return [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    """One per worker process: both files were shipped by SparkContext.addFile."""
    key = (vocabulary, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(SparkFiles.get(vocabulary)), Lexicon.load(SparkFiles.get(lexicon)))
    return _encoders[key]


def map_encoded(docs: DataFrame, path: str, finish: Callable[[np.ndarray, Vocabulary], tuple], names: list[str], kinds: list[str], most: int = MOST_WORDS) -> DataFrame:
    """docs' doc_id with what finish makes of each text's ids; the vocabulary decodes them."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    folder = Path(tempfile.mkdtemp(prefix="quakeframe-bpe-"))
    stem = uuid.uuid4().hex
    files = folder / f"vocabulary-{stem}.json", folder / f"lexicon-{stem}.bin"
    files[0].write_bytes(Path(path).read_bytes())
    build_lexicon(frequent_words(docs, most), Vocabulary(path)).save(str(files[1]))
    for f in files:
        context.addFile(str(f))
    shipped = files[0].name, files[1].name
    schema = pa.schema([pa.field("doc_id", pa.int64()), *(pa.field(n, _ARROW[k]) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shipped)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts, 1 << 21):
                made = [finish(ids, encoder.vocabulary) for ids in encoder.encode(texts[i:j])]
                cols = [pa.array([m[k] for m in made], _ARROW[kind]) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], schema=schema)

    columns = ", ".join(f"{n} {k}" for n, k in zip(["doc_id", *names], ["long", *kinds], strict=True))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def encode_documents(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and, if asked for, decoded."""
    names, kinds = ["n_tokens", "ids", "decoded"], ["long", "array<int>", "string"]
    if decode:
        return map_encoded(docs, path, lambda ids, vocabulary: (len(ids), ids.astype(np.int32), vocabulary.decode(ids)), names, kinds)
    return map_encoded(docs, path, lambda ids, _: (len(ids), ids.astype(np.int32)), names[:2], kinds[:2])


def _digest(ids: np.ndarray, vocabulary: Vocabulary) -> tuple:
    decoded = vocabulary.decode(ids).encode()
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, made in the task from the ids and the decoded text."""
    return map_encoded(docs, path, _digest, ["n_tokens", "ids_sha256", "decoded_sha256"], ["long", "string", "string"])

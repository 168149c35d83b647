"""BPE encoding and decoding by prefix-sharing trie traversal.

The text is cut into words by the tokenizer's own split pattern.  The distinct
words of a batch, in byte order, are a trie read depth first: a word keeps the
states of the prefix that it shares with the word before.  The state of a
prefix is the last token of its encoding: the one token that ends the prefix
and that the encoding of what comes before may stand next to.  So each shared
prefix is encoded once, and a word's tokens are read backwards from its state.

Two tokens may stand side by side if, replaying the merges that made both, no
merge across their border would have come first (the lower rank, and of equal
ranks the left one, is merged first).

The vocabulary file is a parameter; the driver reads it and broadcasts its
tables (their size is the vocabulary's, whatever the data).  Defined results:
a null text is empty; an empty text has no ids; special tokens in a text are
encoded as such, as the file says; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import pieces, texts_of

#: The split pattern of byte-level vocabularies (a fixed value of the file format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words that a Python worker remembers between batches, twice.
REMEMBERED = 1 << 17


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Vocabulary(NamedTuple):
    tokens: list[bytes]  # by id
    merges: list[tuple[int, int, int]]  # left id, right id, merged id; by rank
    special: dict[str, int]


def _letters() -> dict[str, int]:
    """Printable stand-in -> byte: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = _letters()
    ids = file["model"]["vocab"]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        tokens[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    merges = []
    for m in file["model"]["merges"]:
        left, right = m if isinstance(m, list) else m.split(" ")
        merges.append((ids[left], ids[right], ids[left + right]))
    return Vocabulary(tokens, merges, special)


class Remembered:
    """Ids of words seen before, in two generations: what is not asked for
    while the young one fills up is forgotten with the old one."""

    def __init__(self, bound: int = REMEMBERED):
        self.bound, self.young, self.old = bound, {}, {}

    def of(self, words: set, learn) -> dict:
        """A dictionary that holds all of ``words``; ``learn`` gets those not known."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > self.bound:
            self.old, self.young = self.young, {}
            new = words
        if new:
            old = self.old
            self.young |= {w: old[w] for w in new if w in old}
            if missing := new.difference(old):
                self.young |= learn(missing)
        return self.young


class Encoder:
    """Encodes words over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, merges, self.special = vocabulary
        self.rank = [-1] * len(self.tokens)  # single bytes come before all merges
        self.parts = [(i, i) for i in range(len(self.tokens))]
        self.pair: dict[tuple[int, int], int] = {}
        for rank, (left, right, whole) in enumerate(merges):
            self.pair[left, right] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = rank, (left, right)
        self.ids = {}
        for i, t in enumerate(self.tokens):
            if len(t) == 1 and t not in self.ids:
                self.ids[t] = i
        for rank, (left, right, whole) in enumerate(merges):
            # a token that its own merges do not lead to never ends a prefix
            if self.rank[whole] == rank and self._beside(left, right, rank):
                self.ids[self.tokens[whole]] = whole
        self.longest = max(map(len, self.ids), default=1)
        self.beside: dict[int, bool] = {}  # of left * 2^32 + right
        self.words = Remembered()
        self.split = regex.compile(SPLIT)
        self.apart = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None

    def _beside(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge across the border of tokens a and b, with a rank
        below ``limit``, comes before the merges that made a and b."""
        rank, parts, pair = self.rank, self.parts, self.pair
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # undo the later merge; on a tie the right one
                limit, a = rank[a], parts[a][1]
            else:
                limit, b = rank[b] + 1, parts[b][0]

    def learn(self, words: dict, kind: type = np.int32) -> dict:
        """Key -> ids as bytes, of {key: word as bytes}: the trie, depth first."""
        out = {}
        ids, beside, tokens, longest = self.ids, self.beside, self.tokens, self.longest
        path, state = b"", [-1]  # state[n]: last token of the first n bytes
        if len(beside) > 1 << 20:
            beside.clear()
        for word, key in sorted((w, k) for k, w in words.items()):
            common, most = 0, min(len(path), len(word))
            while common < most and path[common] == word[common]:
                common += 1
            del state[common + 1:]
            path = word
            for end in range(common + 1, len(word) + 1):
                for start in range(end - 1, max(end - longest, 0) - 1, -1):
                    token = ids.get(word[start:end])
                    if token is None:
                        continue
                    if not start:
                        break
                    two = state[start] << 32 | token
                    if two not in beside:
                        beside[two] = self._beside(state[start], token)
                    if beside[two]:
                        break
                state.append(token)
            back, at = [], len(word)
            while at:
                back.append(state[at])
                at -= len(tokens[state[at]])
            out[key] = np.array(back[::-1], kind).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [[(p, None) if p not in self.special else ((), self.special[p]) for p in self.apart.split(t)]
               if self.apart and any(s in t for s in self.special) else [(t, None)] for t in texts]
        cut = [[(self.split.findall(p) if p else [], s) for p, s in t] for t in cut]
        new = {w for t in cut for words, _ in t for w in words}
        known = self.words.of(new, lambda words: self.learn({w: w.encode("utf-8", "replace") for w in words}))
        out = [np.frombuffer(b"".join(b"".join([known[w] for w in words]) if s is None else np.int32(s).tobytes()
                                      for words, s in t), np.int32) for t in cut]
        return out

    def decode(self, ids: np.ndarray) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()]).decode("utf-8", "replace")


#: The encoder of this Python worker, by vocabulary: built once, not once a task.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(held, name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(held.value)
    return _ENCODERS[name]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """``columns`` of ``docs`` and ids array<int> of the whole text; with
    ``back`` also text, decoded from these ids in the same pass."""
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    rows = texts_of(docs, *columns)

    def run(batches):
        coder = _encoder(held, path)
        for batch in pieces(batches):
            ids = coder.encode(batch.column("text").to_pylist())
            more = [pa.array([coder.decode(x) for x in ids], pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), _lists(ids), *more],
                                             names=[*columns, "ids", "text"][:len(columns) + 1 + back])

    out = rows.drop("text").withColumn("ids", F.lit(None).cast("array<int>"))
    return rows.mapInArrow(run, (out.withColumn("text", F.lit("")) if back else out).schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text, decoded from ids."""
    held = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        coder = _encoder(held, path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column("ids")
                flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
                text = [coder.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, encoded.withColumn("text", F.lit("")).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    both = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, back=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())

"""Operator 3: byte-level BPE encoding and decoding with forced boundaries.

A byte pair that stands in no token of the vocabulary can stand in no token of
an encoding, so a merge never crosses it: each such pair is a certain cut. A text
is split at special tokens and by the pre-token pattern, each pre-token is split
at its certain cuts, the fragments are encoded on their own and concatenated.
Workers remember the pre-tokens that they have met, within a bound.

Defined results: a null text is an empty one, with no tokens; strings of special
tokens inside texts are those tokens, as the library's default has it; repeated
rows give repeated results; columns of other names are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.common import bounded_batches, fresh, whole_text

#: The pattern that cuts a text into pre-tokens (fixed value of this family).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers, and the longest that it does.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Up to here the pattern's classes agree with the library's; later characters are tried out.
SURE = 0x557
NEVER = 1 << 30
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_pattern() -> re.Pattern:
    """PRE_TOKEN for texts without characters above SURE, its classes written out for a faster engine."""

    def listed(name: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(SURE + 1) if regex.fullmatch(name, chr(c)))

    letter, number, space = listed(r"\p{L}"), listed(r"\p{N}"), listed(r"\s")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next unused one."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Remembered(dict):
    """A dictionary that makes missing values and starts anew from its seed beyond a bound."""

    def __init__(self, make, seed: dict | None = None):
        super().__init__(seed or {})
        self.make, self.seed = make, seed or {}

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.seed):
                self.clear()
                self.update(self.seed)
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary in the library's JSON format."""

    def __init__(self, source: str, seed: dict[str, int] | None = None):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or odd:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        self.source, self.library, self.agreed = source, None, set()
        self.ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.inside = {p for t in self.ids for p in zip(t, t[1:])}  # noqa: B905
        self.letter = dict(enumerate(byte_letters()))
        byte_of = {c: b for b, c in self.letter.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in self.ids.items() if all(c in byte_of for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        named = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(named)})") if named else None
        self.pattern, self.plain = regex.compile(PRE_TOKEN), plain_pattern()
        self.high = re.compile(f"[^\\x00-{chr(SURE)}]")
        self.packed = Remembered(lambda piece: array("I", self.encode_piece(piece)).tobytes())
        self.lengths = Remembered(lambda piece: len(self.encode_piece(piece)), seed)

    def class_agrees(self, char: str) -> bool:
        """Whether the pattern and the library put a character in the same class."""
        cut = self.library.pre_tokenizer.pre_tokenize_str
        for around in (f"a{char}a", f"1{char}1", f"!{char}!", f"a {char}"):
            if [around[a:b] for _, (a, b) in cut(around)] != self.pattern.findall(around):
                return False
        return True

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii() or not self.high.search(text):
            return self.plain.findall(text)
        for char in set(self.high.findall(text)) - self.agreed:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.source)
            if not self.class_agrees(char):  # of a later Unicode than the library's
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            self.agreed.add(char)
        return self.pattern.findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of a text, and whether each is a special token."""
        if self.cut is None or not any(t in text for t in self.special):
            yield text, False
            return
        for i, part in enumerate(self.cut.split(text)):
            if part:
                yield part, bool(i % 2)

    def merge(self, fragment: str) -> list[str]:
        """Tokens of a fragment: merge the pair of least rank, leftmost first, until none is left."""
        if len(fragment) > 64:
            return self.merge_long(fragment)
        part, get = list(fragment), self.rank.get
        ranks = [get(p, NEVER) for p in zip(part, part[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            part[i] += part.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((part[i - 1], part[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((part[i], part[i + 1]), NEVER)
        return part

    def merge_long(self, fragment: str) -> list[str]:
        """The same with a queue of pairs, for fragments of any length."""
        part: list[str | None] = list(fragment)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue = [(r, i, p) for i in range(len(part) - 1) if (r := self.rank.get(p := (part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= len(part) or part[i] != pair[0] or part[j] != pair[1]:
                continue
            part[i], part[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(part) and (r := self.rank.get(p := (part[a], part[b]))) is not None:
                    heapq.heappush(queue, (r, a, p))
        return [p for p in part if p is not None]

    def fragments_of(self, piece: str) -> list[str]:
        """A pre-token in byte letters, split at its certain cuts."""
        if piece.isascii() and piece.isprintable():  # only the blank has another letter
            s = piece.replace(" ", self.letter[32])
        else:
            s = piece.encode().decode("latin-1").translate(self.letter)
        inside = self.inside
        cuts = [i for i, p in enumerate(zip(s, s[1:]), 1) if p not in inside]  # noqa: B905
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)] if cuts else [s]

    def encode_piece(self, piece: str) -> list[int]:
        return [self.ids[t] for fragment in self.fragments_of(piece) for t in self.merge(fragment)]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for part, special in self.parts(text):
            if special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += map(self.packed.__getitem__, self.pre_tokens(part))
        return b"".join(out)

    def count(self, text: str) -> int:
        """Number of tokens of a text, by the remembered lengths of its pre-tokens."""
        return sum(
            1 if special else sum(map(self.lengths.__getitem__, self.pre_tokens(part)))
            for part, special in self.parts(text)
        )

    def decode_packed(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _coder(source: str) -> ByteBpe:
    return ByteBpe(source)


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read once on the driver and broadcast; its size is checked."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if len(source) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    return spark.sparkContext.broadcast(source)


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, token_ids (packed little-endian uint32) and the decoded text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = shared_vocabulary(spark, path or vocabulary_path())

    @F.pandas_udf("struct<token_ids:binary,decoded:string>")
    def coded(texts: pd.Series) -> pd.DataFrame:
        coder = _coder(shared.value)
        ids = [coder.encode_packed(t) for t in texts]
        return pd.DataFrame({"token_ids": ids, "decoded": [coder.decode_packed(x) for x in ids]})

    done = docs.select(F.col(id_col).alias("doc_id"), coded(whole_text(text_col)).alias("coded"))
    return done.select(
        "doc_id",
        (F.octet_length("coded.token_ids") / 4).cast("long").alias("n_tokens"),
        F.col("coded.token_ids").alias("token_ids"),
        F.col("coded.decoded").alias("decoded"),
    )


def bpe_report(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of the decoded text."""
    return bpe_encode(docs, path, id_col, text_col).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_tokens(
    docs: DataFrame, ids: str = "token_ids", count: str = "n_tokens", restored: str = "restored", path: str | None = None, text_col: str = "text"
) -> DataFrame:
    """``docs`` with its packed token ids, their number, and whether they decode to the text; null counts as empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = shared_vocabulary(spark, path or vocabulary_path())

    @F.pandas_udf("struct<ids:binary,restored:boolean>")
    def tokens(texts: pd.Series) -> pd.DataFrame:
        coder = _coder(shared.value)
        packed = [coder.encode_packed(t) for t in texts]
        return pd.DataFrame({"ids": packed, "restored": [coder.decode_packed(x) == t for x, t in zip(packed, texts, strict=True)]})

    (coded,) = fresh(docs, "coded")
    done = docs.withColumn(coded, tokens(whole_text(text_col)))
    return done.withColumns({ids: F.col(f"{coded}.ids"), count: (F.octet_length(f"{coded}.ids") / 4).cast("long"), restored: F.col(f"{coded}.restored")}).drop(coded)

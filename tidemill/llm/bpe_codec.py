"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

Every prefix of a piece has exactly one token that can end its encoding. The tokens
that are suffixes of a prefix come from a suffix-matching automaton over the whole
vocabulary; the one that holds is found by a pair-compatibility test against the last
token stored for the shorter prefix: two neighbours are compatible if undoing their
merges, latest first, never meets a merge across the boundary that would have come
earlier. Following the stored tokens back from the end gives the ids, without running
the merge loop.

The vocabulary here is lower-cased, white-space dropping and has word ends (a suffix on
the last symbol of a piece), so pieces are short and repeat; their results are kept in a
bounded cache per worker. One narrow pass over the documents, no shuffle.

Defined results: a null text counts as empty and has no ids (and decodes to the empty
text); the strings of special tokens in a text are encoded as those tokens; repeated
rows are returned as often as they come; a null doc_id stays null; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, lean, table

VOCABULARY = "word_bpe_49k.json"
#: Entries of each generation of the per-worker caches: white-space separated chunks and their pieces; tested pairs of tokens.
CACHE_CHUNKS = 100_000
CACHE_PAIRS = 200_000
#: Longer ones are not cached.
CACHE_CHARS = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from U+0100."""
    stays = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in stays:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class _Pairs(dict):
    """``left << 20 | right`` -> whether the two may stand side by side; emptied when full."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        self[pair] = fits = self.bpe._apart(pair >> 20, pair & 0xFFFFF, 1 << 60)
        return fits


class PrefixBpe:
    """A vocabulary with its merges, ready to encode pieces.

    Symbols are characters of a private alphabet: ``chr(b)`` for byte ``b`` within a
    piece and ``chr(256 + b)`` for the last byte, which carries the word end.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        shown = byte_symbols()
        byte_of = {c: b for b, c in enumerate(shown)}
        self.form: dict[int, str] = {}
        for b, c in enumerate(shown):
            self.form[vocab[c]] = chr(b)
            if self.end:
                self.form[vocab[c + self.end]] = chr(256 + b)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.result: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank[pair] = rank
            self.result[pair] = whole
            if whole not in self.made:
                self.made[whole], self.halves[whole] = rank, pair
        self.byte_of = byte_of
        self.pairs = _Pairs(self)
        automaton = ahocorasick.Automaton()
        for form, token in ((f, t) for t, f in self.form.items()):
            automaton.add_word(form, (token, 1))
        #: Tokens that their own bytes encode to, in order of their merges, so that halves come first.
        solid = set(self.form)
        for token, rank in sorted(self.made.items(), key=lambda x: x[1]):
            left, right = self.halves[token]
            if left in self.form and right in self.form:
                self.form[token] = self.form[left] + self.form[right]
                if left in solid and right in solid and self._apart(left, right, rank):
                    solid.add(token)
                    automaton.add_word(self.form[token], (token, len(self.form[token])))
        automaton.make_automaton()
        self.automaton = automaton
        self.length_of = [len(self.form.get(t, "")) for t in range(max(self.form) + 1)]
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge before ``limit`` joins something across the boundary of two encoded neighbours.

        Undoes the later of the two tokens' own merges, so the boundary is seen as it was at each
        earlier time. ``limit`` is the time until which the tokens now at the boundary stay there;
        among merges of one rank the leftmost comes first, so a merge across the boundary wins a
        tie against one on its right and loses a tie against one on its left.
        """
        rank, made, halves = self.rank, self.made, self.halves
        while True:
            across = rank.get((left, right))
            if across is not None and across < limit:
                return False
            l, r = made.get(left, -1), made.get(right, -1)
            if l < 0 and r < 0:
                return True
            if l > r:
                # the left token came last: before that its right half stood at the boundary
                left, limit = halves[left][1], l
            else:
                # on a tie (the same merge on both sides) the left one came first
                right, limit = halves[right][0], r + 1

    def compatible(self, left: int, right: int) -> bool:
        return self.pairs[left << 20 | right]

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        last = [-1] * (len(symbols) + 1)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] < 0:
                start = end - length
                if not start or pairs[last[start] << 20 | token]:
                    last[end] = token
        out, at, length_of = [], len(symbols), self.length_of
        while at:
            token = last[at]
            out.append(token)
            at -= length_of[token]
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        return self.encode_symbols(raw[:-1] + chr(256 + ord(raw[-1])) if self.end else raw)


#: Letters and numbers of later Unicode versions, which the tokenizers library takes for other characters.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 1C89 208F 209D-209F A7CB-A7CC A7CE-A7CF A7D2 A7D4 A7DA A7DC-A7DD A7E2 A7F1
AB6C-AB6D 107BB-107BF 10940-10959 10D50-10D65 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8
16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
_NEWER = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER)
#: How the vocabulary's own file cuts a normalised text into pieces (fixed value).
PIECE = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_NEWER}]]+|[\p{{N}}--[{_NEWER}]]|[^\p{{White_Space}}[[\p{{L}}\p{{N}}]--[{_NEWER}]]]+")
#: The same, where only ASCII occurs.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^\t\n\v\f\r a-zA-Z0-9]+")


#: Lower case of capitals that are newer than Python's tables (first, last, distance).
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
#: With the final sigma, which no rule about its neighbours may change here.
_CAPITALS = {c: c + d for a, z, d in NEWER_CAPITALS for c in range(a, z + 1)} | {ord("Σ"): ord("σ")}
_ANY_CAPITAL = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z, _ in NEWER_CAPITALS) + "Σ]")


def normalise(text: str) -> str:
    """NFC, then lower case one character at a time (no rule looks at neighbours)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.translate(_CAPITALS) if _ANY_CAPITAL.search(text) else text).lower()


class _Aging(dict):
    """A cache of two generations: when the young one is full it becomes the old one."""

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


#: White space as the normaliser's pattern has it; str.split() also splits at U+001C..U+001F, which it doesn't.
_SPACE = re.compile(r"[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


class Codec:
    def __init__(self, path: str):
        self.bpe = PrefixBpe(path)
        self.chunks = _Aging(CACHE_CHUNKS, self._chunk)

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids, token_of = self.bpe.encode_piece(piece), self.bpe.token_of
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([token_of[i] for i in ids])

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids as bytes, and the decoded text, of a white-space separated part of a normalised text.

        A piece of a chunk is cut into itself, so both share one cache.
        """
        if chunk.isascii():
            if chunk.isalpha():
                return self._piece(chunk)
            found = ASCII_PIECE.findall(chunk)
        else:
            found = PIECE.findall(chunk)
        if len(found) == 1:
            return self._piece(found[0])
        got = list(map(self.chunks.__getitem__, found))
        return b"".join([x[0] for x in got]), " ".join([x[1] for x in got])

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        text = normalise(text)
        parts = (x for x in _SPACE.split(text) if x) if _SEPARATORS.search(text) else text.split()
        return list(map(self.chunks.__getitem__, parts))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and their decoding."""
        split = self.bpe.special_split
        if split is None or not split.search(text):
            got = self._plain(text)
        else:
            got = []
            for part in split.split(text):
                if (special := self.bpe.special.get(part)) is not None:
                    got.append((struct.pack("<I", special), part))
                else:
                    got += self._plain(part)
        return b"".join([x[0] for x in got]), " ".join([x[1] for x in got if x[1]])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker and vocabulary."""
    return Codec(path)


def encode_text(text: str | None, path: str | None = None) -> list[int]:
    ids = codec(path or default_vocabulary()).encode(text or "")[0]
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """The vocabulary names no decoder, so its tokens are joined by spaces."""
    return " ".join(codec(path or default_vocabulary()).bpe.token_of[i] for i in ids)


def _digests(path: str | None):
    def run(batches):
        own = codec(path or default_vocabulary())
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for text in batch.column(1):
                ids, decoded = own.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _full(path: str | None):
    def run(batches):
        own = codec(path or default_vocabulary())
        for batch in batches:
            both = [own.encode(text.as_py() or "") for text in batch.column(1)]
            ids = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x, _ in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([x for _, x in both], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids of every whole text, and the text decoded from them."""
    return _narrow(docs).mapInArrow(lean(_full(vocabulary)), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode_documents``, with counts and digests in place of the ids and the text."""
    return _narrow(docs).mapInArrow(lean(_digests(vocabulary)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return encode_digests(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: digests of every document's ids and of its decoded text."""
    bounded_batches(spark)
    return encode_digests(docs)

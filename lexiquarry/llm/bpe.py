"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie in one symbol sequence, linked left and right. An index maps each
mergeable pair, by its rank, to all its positions in that sequence. Active ranks are taken in ascending
order; a rank's positions are merged together, and the pairs that appear to their left and right are
added to the lists of their own ranks. A word's merges so come in the order of its lowest rank, which is
what encoding each word alone would give.

Words found once are kept in a bounded table per Python worker; the table only saves time and is emptied
when full.

Cases: a null text counts as empty; an empty text has no ids and decodes to the empty string; texts are
taken whole, whatever their length; repeated rows give repeated results; an empty table gives an empty
table with the same schema; other columns stay, and a column that has the name of a result column is an
error that names it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.shared import give_back, table

#: Chunks between white space that a worker keeps; about 150 bytes each, and as much for their pieces.
KEPT = 150_000


# Letters and numbers assigned after Unicode 16, which the vocabulary's library takes for neither.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names, spare = {b: chr(b) for b in plain}, iter(range(256, 512))
    return [names[b] if b in names else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ranks, ids and text rules of a word-end BPE file of the ``tokenizers`` library."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.tokens = [""] * (max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pieces)
        alphabet = byte_alphabet()
        self.inner = np.array([ids.get(c, -1) for c in alphabet], dtype=np.int64)
        self.last = np.array([ids.get(c + self.suffix, -1) for c in alphabet], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.width = len(self.tokens) + 1
        keys = self.left * self.width + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.found: dict[bytes, bytes] = {}
        self.pieces_found: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """NFC and each character's own lower case. White space stays: no piece holds any."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a final sigma is not told apart

    def chunks(self, text: str) -> list[bytes]:
        """What stands between ASCII white space, normalised; a special token stands as itself after a byte that no text holds."""
        if self.special_cut is None or "<" not in text:
            return self.normal(text).encode("utf-8", "replace").split()
        out: list[bytes] = []
        for k, part in enumerate(self.special_cut.split(text)):
            out += [b"\xff" + part.encode()] if k % 2 else self.normal(part).encode("utf-8", "replace").split()
        return out

    def pieces_of(self, chunk: str) -> list[str]:
        """The pieces of a chunk; characters of ``LATER`` count as neither letters nor numbers."""
        if chunk.isascii() or not _LATER.search(chunk):
            return self.pieces.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pieces.finditer(_LATER.sub("\1", chunk))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for one that has none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        # One symbol a byte, and a stop symbol (-1) before, between and after the words.
        start = np.concatenate(([0], np.cumsum(size + 1))) + 1
        total = int(start[-1])
        codes = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", dtype=np.uint8)
        sym = self.inner[codes]
        sym[start[:-1] + size - 1] = self.last[codes[start[:-1] + size - 1]]
        sym[start - 1] = -1
        nxt, prv = np.arange(1, total + 1), np.arange(-1, total - 1)
        nxt[-1] = total - 1
        prv[0] = 0
        first = self.ranks(sym[:-1], sym[1:])
        at = np.flatnonzero(first >= 0)
        order = at[np.argsort(first[at], kind="stable")]
        ranked = first[order]
        cuts = np.flatnonzero(np.diff(ranked)) + 1
        begin = np.concatenate(([0], cuts)) if len(order) else np.empty(0, dtype=np.int64)
        given = dict(zip(ranked[begin].tolist(), zip(begin.tolist(), [*cuts.tolist(), len(order)]), strict=True)) if len(order) else {}
        later: dict[int, list[int]] = defaultdict(list)
        heap = list(given)
        heapq.heapify(heap)
        last = -1
        while heap:
            rank = heapq.heappop(heap)
            if rank == last:
                continue
            last = rank
            cut, more = given.pop(rank, None), later.pop(rank, None)
            pos = order[cut[0] : cut[1]] if cut else np.empty(0, dtype=np.int64)
            if more:
                pos = np.concatenate((pos, np.array(more, dtype=np.int64)))
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            mate = nxt[pos]
            pos = pos[(sym[pos] == a) & (sym[mate] == b)]
            if more and len(pos) > 1:
                pos = np.unique(pos)
            if a == b and len(pos) > 1:  # of a run of equal symbols, every second pair from the left
                free, chosen = -1, []
                for p in pos.tolist():
                    if p != free:
                        chosen.append(p)
                        free = int(nxt[p])
                    else:
                        free = -1
                pos = np.array(chosen, dtype=np.int64)
            if not len(pos):
                continue
            mate = nxt[pos]
            after = nxt[mate]
            sym[pos] = new
            sym[mate] = -2
            nxt[pos] = after
            prv[after] = pos
            before = prv[pos]
            where = np.concatenate((before, pos))
            got = self.ranks(sym[where], sym[np.concatenate((pos, after))])
            hit = np.flatnonzero(got >= 0)
            if len(hit):
                for r, p in zip(got[hit].tolist(), where[hit].tolist(), strict=True):
                    if r not in later and r not in given:
                        heapq.heappush(heap, r)
                    later[r].append(p)
        live = np.flatnonzero(sym >= 0)
        ids = sym[live].astype("<u4").tobytes()
        ends = (np.searchsorted(live, start) * 4).tolist()
        return [ids[ends[k] : ends[k + 1]] for k in range(len(words))]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        unseen = set().union(*cut).difference(self.found)
        if len(self.found) + len(unseen) > KEPT:
            self.found, self.pieces_found = {}, {}
            unseen = set().union(*cut)
        specials = {b"\xff" + token.encode(): i.to_bytes(4, "little") for token, i in self.special.items()}
        pieces = {c: self.pieces_of(c.decode()) for c in unseen if c not in specials}
        new = list(set().union(*pieces.values()).difference(self.pieces_found))
        if new:
            self.pieces_found.update(zip(new, self.merge(new), strict=True))
        ids = self.pieces_found
        self.found.update((c, ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p))) for c, p in pieces.items())
        self.found.update((c, specials[c]) for c in unseen.intersection(specials))
        return [b"".join(map(self.found.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids``, one space between them: the file names no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[int, Vocabulary] = {}


def _loaded(raw) -> Vocabulary:
    if raw.id not in _LOADED:
        _LOADED.clear()
        _LOADED[raw.id] = Vocabulary(raw.value)
    return _LOADED[raw.id]


class _Shipped:
    """The vocabulary file, of fixed size, as a broadcast and the key under which a worker keeps it."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self.file = spark.sparkContext.broadcast(f.read())
        self.id = hash(path)

    @property
    def value(self) -> bytes:
        return self.file.value


#: Texts that are encoded together, in characters.
BATCH_CHARS = 4_000_000


def _apply(df: DataFrame, source: str, made: list[tuple[T.StructField, pa.DataType]], call) -> DataFrame:
    """``df`` with the columns ``made`` from ``source`` a few MB at a time."""
    for field, _ in made:
        if field.name in df.columns:
            raise ValueError(f"the table has a column {field.name} already")
    schema = T.StructType([*df.schema.fields, *(field for field, _ in made)])
    n = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.maximum(pa.compute.fill_null(pa.compute.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False), 1)
            part = np.cumsum(size) // BATCH_CHARS
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                rows = batch.slice(int(at[0]), len(at))
                new = [pa.array(values, type=kind) for values, (_, kind) in zip(call(rows.column(n).to_pylist()), made, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=schema.fieldNames())
        give_back()

    return df.mapInArrow(run, schema)


def _ids(name: str) -> tuple[T.StructField, pa.DataType]:
    return T.StructField(name, T.BinaryType()), pa.binary()


def _text(name: str) -> tuple[T.StructField, pa.DataType]:
    return T.StructField(name, T.StringType()), pa.string()


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Adds the ids of each text, packed as little-endian unsigned 32-bit integers."""
    shipped = _Shipped(df.sparkSession, vocab_path)
    return _apply(df, text_col, [_ids(ids_col)], lambda texts: [_loaded(shipped).encode([t or "" for t in texts])])


def decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of each packed id list, special tokens included."""
    shipped = _Shipped(df.sparkSession, vocab_path)

    def call(packed: list[bytes | None]) -> list[list[str]]:
        vocabulary = _loaded(shipped)
        return [[vocabulary.decode(x or b"") for x in packed]]

    return _apply(df, ids_col, [_text(text_col)], call)


def round_trip(df: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` and, decoded from those in the same worker, ``decoded``."""
    shipped = _Shipped(df.sparkSession, vocab_path)

    def call(texts: list[str | None]) -> list[list]:
        vocabulary = _loaded(shipped)
        packed = vocabulary.encode([t or "" for t in texts])
        return [packed, [vocabulary.decode(x) for x in packed]]

    return _apply(df, text_col, [_ids("token_ids"), _text("decoded")], call)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digests(df: DataFrame) -> DataFrame:
    """The result columns of ``op9_bpe``: counts and digests of what :func:`round_trip` made."""
    return df.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary()))

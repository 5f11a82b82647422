"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenized once; only the lengths and checksums of their pieces are kept. The histogram of lengths (at
most as many rows as a sequence has tokens) is packed on the driver, longest lengths first, into counted patterns; the
pieces find their place in a pattern by their rank among pieces of equal length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import chunks, ship, stage

LENGTH = 4096
#: Words in a generation of a worker's cache; the generation before is kept beside it. Workers live on between stages, so
#: both together (some 70 MB) come on top of what later stages need.
CACHE_WORDS = 200_000
#: Characters of a text that are cut into words at once.
TEXT_PART = 1 << 20
#: Words that the tokenizer's normalizer leaves as they are: ASCII without capitals, and the small letters of Latin-1.
_STABLE = re.compile(r"[!-@\[-~ß-öø-ÿ]+")
#: Latin-1 bytes in lower case, line feeds as blanks.
_FOLD = bytes(0x20 if c == 0x0A else ord(chr(c).lower()) for c in range(256))
#: Of Latin-1 bytes: blank, letter or digit, anything else.
_CLASS = bytes(0x20 if c == 0x20 else 0x61 if chr(c).isalnum() else 0x70 for c in range(256))


def _word_pattern(spec: dict) -> str | None:
    """The pattern of words of a tokenizer that lower-cases, then cuts by a pattern, then runs a byte-level BPE on each
    word; None for any other kind."""
    norm, pre, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
    steps = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
    if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model["type"] != "BPE" or model.get("dropout"):
        return None
    split, level = pre["pretokenizers"]
    plain = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
    return split["pattern"].get("Regex") if plain else None


class WordIds:
    """Token ids of a text, word by word: the tokenizer drops white space and never joins across it.

    Each spelling is encoded once and then looked up. Words that the normalizer leaves alone are cut by the tokenizer's
    own pattern and their parts go straight to its BPE model; all others take its whole way."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pattern = _word_pattern(json.loads(self.tokenizer.to_str()))
        self.pattern = regex.compile(pattern) if pattern else None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        # The tokenizer looks for added tokens before it lower-cases.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.new.get(part)
        if found is None:
            mapped = part if part.isascii() else part.translate(self.letters)
            found = self.new[part] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found

    def _learn(self, missing: list[str]) -> None:
        whole = []
        for w in missing:
            if found := self.old.get(w):
                self.new[w] = found
            elif self.pattern is None or not _STABLE.fullmatch(w):
                whole.append(w)
            elif w.isalpha():
                self._part(w)
            elif any(t in w for t in self.added):
                whole.append(w)
            else:
                self.new[w] = b"".join(map(self._part, self.pattern.findall(w)))
        for w, x in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self.new[w] = array("I", x.ids).tobytes()

    def _words(self, text: str) -> list[str]:
        """The text cut at blanks and line feeds. Latin-1 texts are lower-cased first, and points and commas at the ends
        of words become words of their own, as the tokenizer would do it, so that fewer different words arise; not so
        where lower case could make an added token."""
        if self.pattern:
            try:
                raw = text.encode("latin-1").translate(_FOLD)
            except UnicodeEncodeError:
                raw = None
            if raw is not None:
                low = raw.decode("latin-1")
                if not any(t in low for t in self.added):
                    if b"pp " not in raw.translate(_CLASS):
                        low = low.replace(". ", " . ").replace(", ", " , ")
                    return low.split(" ")
        return text.replace("\n", " ").split(" ")

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {"": b""}
        split = [self._words(t) for t in texts]
        distinct = list(set().union(*split))
        own = dict(zip(distinct, map(self.new.get, distinct), strict=True))
        if missing := [w for w, found in own.items() if found is None]:
            self._learn(missing)
            own.update((w, self.new[w]) for w in missing)
        return [b"".join(map(own.__getitem__, ws)) for ws in split]

    def of_long(self, text: str) -> bytes:
        """The same for one text of any length, cut at blanks into parts of about TEXT_PART characters."""
        out, a = [], 0
        while a < len(text):
            z = text.find(" ", a + TEXT_PART)
            z = len(text) if z < 0 else z
            out += self.of([text[a:z]])
            a = z
        return b"".join(out)


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own, kept from task to task."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def _pieces(path: str, end_id: int, length: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids = word_ids(path)
        for batch in batches:
            for i, n, _, offsets in chunks(batch.column(1)):
                texts, out = pc.fill_null(batch.column(1).slice(i, n), "").to_pylist(), []
                found = ids.of(texts) if offsets[-1] <= 2 * TEXT_PART else map(ids.of_long, texts)
                for doc, raw in zip(batch.column(0).slice(i, n).to_pylist(), found, strict=True):
                    raw += end
                    tokens = len(raw) // 4
                    for a in range(0, tokens, length):
                        part = raw[4 * a : 4 * (a + length)]
                        out.append((doc, a, len(part) // 4, zlib.crc32(part), tokens))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (how often, lengths) of each pattern. Lengths go longest first, each to the packs with the
    most room left; a group of equal packs is split when fewer pieces than packs remain."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        at = length
        while left:
            while at >= size and not room[at]:
                at -= 1
            if at < size:
                # No pack has room: as many new ones as hold the rest of this length.
                per = length // size
                full, more = divmod(left, per)
                if full:
                    room[length - per * size].append((full, [size] * per))
                if more:
                    room[length - more * size].append((1, [size] * more))
                break
            n, pack = room[at].pop()
            take = min(n, left)
            if n > take:
                room[at].append((n - take, pack))
            room[at - size].append((take, [*pack, size]))
            left -= take
    return [x for packs in room.values() for x in packs]


def _places(patterns: list[tuple[int, list[int]]]):
    """For each length the slots in rank order: first rank, first sequence, offset; keyed for a binary search."""
    used: dict[int, int] = defaultdict(int)
    slots, base = [], 0
    for n, pack in patterns:
        offset = 0
        for size in pack:
            slots.append((size, used[size], base, offset))
            used[size] += n
            offset += size
        base += n
    slots.sort()
    size, rank, seq, offset = (np.array(x, np.int64) for x in zip(*slots, strict=True))
    return (size << 48) + rank, seq - rank, offset


def _assign(places):
    key, shift, offset = places

    def run(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(shift[at] + rank), pa.array(offset[at])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file, the same on all machines, whose tokens never span a blank or a line feed. Every
    document ends with end_id, so a null or empty text is one piece of one token. A document longer than a sequence fills whole sequences; its rest is
    packed. Rows that repeat a doc_id are packed as documents of their own; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    doc = docs.schema["doc_id"].dataType.simpleString()
    base = f"doc_id {doc}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stage(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, length), base), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Pieces of one length are ranked in about sqrt(n) / 4 groups of 4 * sqrt(n), however common the length is.
    groups = spark.createDataFrame([(k, max(1, int(n**0.5 / 4))) for k, n in counts.items()], "length long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.col("salts"))
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", salt).drop("salts")  # at most `length` rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("own") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_assign(_places(pack_histogram(counts, length))), base + ", sequence_id long, offset long")

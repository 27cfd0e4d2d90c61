"""Token ids in files of directly addressable codes: any token can be read without decoding a block.

An id is cut into chunks from its low bits upwards. Level k holds the k-th chunks of the ids that have one, as planes of bytes and
half bytes; a bitmap beside it says which of them go on to the next level, and a directory of counts every RANK_BITS bits turns a
place in the bitmap into a place on the next level. The widths of the chunks, multiples of half a byte, are those that make a
segment smallest, found from the counts of id lengths. A file is a run of segments of SEGMENT ids each (the last one shorter), so the segment of a token follows
from its number, then a table of the documents in it, and a footer that says where things are.

Documents are dealt out by ranges of their ids, so that files follow each other in ascending order of doc_id.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.worker import shared
from .common import cut, ensure_checkpoint_dir
from .warc import _open

SEGMENT = 1 << 20  # ids in a segment
UNIT = 4  # widths of chunks are multiples of so many bits
RANK_BITS = 512  # bits of a bitmap for each entry of its directory
END = 2  # the id after each document
PIECE = 1 << 18  # ids read at a time
MAGIC = b"DAC-ids1"
CACHE, CACHED = 1_000_000, 40  # pieces of text whose ids a worker keeps, characters of a piece at most

#: Before a single space or line end between characters that are surely no white space a new word of a byte-level tokenizer
#: begins, whatever surrounds it, so what stands on either side is encoded by itself. So do a line end's next word, and these
#: marks after a letter.
_INK = "!-~¡-ᙿ、-퟿"
_GAP = re.compile(rf"([ \n])(?=[{_INK}])(?<=[{_INK}].)", re.S)
_EVEN, _PIECE = re.compile(rf"[{_INK}]++(?:[ \n][{_INK}]++)*+"), re.compile(r"[ \n]?[^ \n]++")  # texts that only have such gaps, and what is between
_MARKS, _LETTERS = ".,;:!?*$&#%|", "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD, _LETTER = re.compile(f" ?[{_LETTERS}]+"), re.compile(f"[{_LETTERS}]")


class Pieces(dict):
    """The ids (bytes, little-endian unsigned 32-bit) of pieces of text; those of short ones are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are text
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        cut_up = conf["pre_tokenizer"] or {}
        self.apart = conf["normalizer"] is None and cut_up.get("type") == "ByteLevel" and cut_up.get("use_regex", True) and not cut_up.get("add_prefix_space") and conf["model"]["type"] == "BPE"
        if self.apart:
            spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.spelling = {c: spelled(chr(c))[0][0] for c in [32, *range(0xC0, 0x250)]}
            self.model = self.tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > CACHED:
            return self._ids(piece)
        bare = piece.rstrip(_MARKS)
        if _WORD.fullmatch(piece):
            spelled = piece.replace(" ", self.spelling[32]) if piece.isascii() else piece.translate(self.spelling)
            ids = self._pack([t.id for t in self.model.tokenize(spelled)])
        elif piece[0] == "\n" and _LETTER.match(piece, 1):
            ids = self["\n"] + self[piece[1:]]
        elif len(bare) < len(piece) and bare and _LETTER.match(bare[-1]):
            ids = self[bare] + self[piece[len(bare) :]]
        else:
            ids = self._ids(piece)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, piece: str) -> bytes:
        return self._pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, the same as of the whole text at once, and END."""
        if not self.apart:
            return np.frombuffer(self._ids(text) + self._pack([END]), "<u4")
        if _EVEN.fullmatch(text):
            found = map(self.__getitem__, _PIECE.findall(text))
        else:
            parts = _GAP.split(text)
            found = [self[x] for x in (parts[0], *map("".join, zip(parts[1::2], parts[2::2]))) if x]
        return np.frombuffer(b"".join(found) + self._pack([END]), "<u4")


def widths(ids: np.ndarray) -> list[int]:
    """The widths of chunks, low ones first, for which ids take the fewest bits."""
    most = max(UNIT, -(-int(ids.max(initial=1)).bit_length() // UNIT) * UNIT)
    longer = {at: int(np.count_nonzero(ids >> np.uint32(at))) if at else len(ids) for at in range(0, most, UNIT)}  # ids of more than so many bits
    best = {most: (0.0, [])}
    for at in range(most - UNIT, -1, -UNIT):
        best[at] = min((longer[at] * (w + (at + w < most) * (1 + 32 / RANK_BITS)) + best[at + w][0], [w, *best[at + w][1]]) for w in range(UNIT, most - at + 1, UNIT))
    return best[0][1]


def _planes(width: int) -> list[int]:
    return [8] * (width // 8) + [4] * (width % 8 // 4)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Planes of values, one after the other: a byte of each value, or half a byte, two in a byte."""
    out, shift = [], 0
    for bits in _planes(width):
        plane = (values >> np.uint32(shift)).astype(np.uint8)
        if bits == 4:
            plane = np.append(plane & 15, np.zeros(len(plane) % 2, np.uint8))
            plane = plane[0::2] | plane[1::2] << 4
        out.append(plane.tobytes())
        shift += bits
    return b"".join(out)


def segment(ids: np.ndarray) -> tuple[dict, bytes]:
    """The levels of ids: their widths and counts, and the bytes of chunks, bitmap and directory of each in turn."""
    ws, counts, out = widths(ids), [], []
    for k, w in enumerate(ws):
        counts.append(len(ids))
        out.append(_pack(ids, w))
        if k < len(ws) - 1:
            more = ids >> np.uint32(w) > 0
            marks = np.packbits(more, bitorder="little")
            ends = np.cumsum(np.add.reduceat(np.bitwise_count(marks), np.arange(0, len(marks), RANK_BITS // 8), dtype=np.int64)) if len(marks) else np.zeros(0, np.int64)
            out += [marks.tobytes(), np.r_[0, ends[:-1]][: len(ends)].astype("<u4").tobytes()]
            ids = ids[more] >> np.uint32(w)
    return {"widths": ws, "counts": counts}, b"".join(out)


def _places(head: dict) -> list[tuple[list[tuple[int, int]], int, int]]:
    """Where planes (place, bits), bitmap and directory of each level begin, from the begin of the segment."""
    out, at = [], 0
    for k, (w, n) in enumerate(zip(head["widths"], head["counts"])):
        planes = []
        for bits in _planes(w):
            planes.append((at, bits))
            at += -(-n * bits // 8)
        ranks = at + -(-n // 8)
        out.append((planes, at, ranks))
        at = ranks + 4 * -(-n // RANK_BITS) if k < len(head["widths"]) - 1 else at
    return out


class Writer:
    """Writes ids of documents into one file."""

    def __init__(self, out):
        self.out, self.at, self.n, self.held, self.size, self.segments, self.docs, self.sizes = out, 0, 0, [], 0, [], [], []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray) -> None:
        """The ids of the next document."""
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= SEGMENT:
            self._flush(SEGMENT)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held)
        for k in range(0, len(ids) - least + 1, SEGMENT):
            head, data = segment(ids[k : k + SEGMENT])
            self.segments.append(head | {"at": self.at})
            self._put(data)
            self.n += sum(head["counts"][:1])
        rest = ids[(k + SEGMENT) :]
        self.held, self.size = [rest], len(rest)

    def close(self, doc_ids: list[pa.Array]) -> None:
        """The documents' ids, in the order in which their tokens were added, end the file."""
        if self.size:
            self._flush(1)
        table = pa.table({"doc_id": pa.chunked_array(doc_ids), "n_tokens": pa.array(self.sizes, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        footer = {"docs": self.at, "n": self.n, "segment": SEGMENT, "segments": self.segments}
        self._put(sink.getvalue().to_pybytes())
        at = self.at
        self._put(json.dumps(footer).encode())
        self._put(at.to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads tokens of a file by their numbers. f: a file that can be read at any place, of so many bytes."""

    def __init__(self, f, size: int):
        self.f, tail = f, f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids")
        at = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(f.read_at(size - 16 - at, at))
        self.docs = pa.ipc.open_stream(f.read_at(at - self.footer["docs"], self.footer["docs"])).read_all()
        self.n = self.footer["n"]

    def _rank(self, base: int, bitmap: int, ranks: int, place: int) -> int:
        """How many of the first `place` entries of a level go on to the next."""
        block, rest = divmod(int(place), RANK_BITS)
        if not place:
            return 0
        if not rest:  # the directory has an entry for each begun block only
            block, rest = block - 1, RANK_BITS
        before = int.from_bytes(self.f.read_at(4, base + ranks + 4 * block), "little")
        bits = int.from_bytes(self.f.read_at(-(-rest // 8), base + bitmap + block * RANK_BITS // 8), "little")
        return before + (bits & ((1 << rest) - 1)).bit_count()

    def token(self, i: int) -> int:
        """Token number i of the file: a few bytes of each level that it has."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        head = self.footer["segments"][i // self.footer["segment"]]
        place, value, shift, base = i % self.footer["segment"], 0, 0, head["at"]
        for k, (planes, bitmap, ranks) in enumerate(_places(head)):
            for at, bits in planes:
                byte = self.f.read_at(1, base + at + place * bits // 8)[0]
                value |= (byte if bits == 8 else byte >> 4 * (place % 2) & 15) << shift
                shift += bits
            if k == len(head["widths"]) - 1 or not self.f.read_at(1, base + bitmap + place // 8)[0] >> (place % 8) & 1:
                break
            place = self._rank(base, bitmap, ranks, place)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b - 1 of the file."""
        step, out = self.footer["segment"], []
        while a < b:
            s, first = divmod(a, step)
            last = min(step, b - s * step)
            out.append(self._of_segment(self.footer["segments"][s], first, last))
            a += last - first
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def _plane(self, at: int, bits: int, a: int, b: int) -> np.ndarray:
        """Entries a to b - 1 of a plane."""
        low = a * bits // 8
        data = np.frombuffer(self.f.read_at(-(-b * bits // 8) - low, at + low), np.uint8)
        if bits == 8:
            return data
        both = np.empty(2 * len(data), np.uint8)
        both[0::2], both[1::2] = data & 15, data >> 4
        return both[a % 2 :][: b - a]

    def _of_segment(self, head: dict, a: int, b: int) -> np.ndarray:
        out, where, shift, base = np.zeros(b - a, "<u4"), slice(None), 0, head["at"]
        for k, (planes, bitmap, ranks) in enumerate(_places(head)):
            value = np.zeros(b - a, "<u4")
            for at, bits in planes:
                value |= self._plane(base + at, bits, a, b).astype("<u4") << np.uint32(shift)
                shift += bits
            out[where] |= value
            if k == len(head["widths"]) - 1:
                break
            bitmap_bits = np.unpackbits(np.frombuffer(self.f.read_at(-(-b // 8) - a // 8, base + bitmap + a // 8), np.uint8), bitorder="little")[a % 8 :][: b - a]
            on = np.flatnonzero(bitmap_bits)
            where = on if k == 0 else where[on]
            a = self._rank(base, bitmap, ranks, a)
            b = a + len(on)
            if a == b:
                break
        return out


def write_files(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Encodes docs into files under folder (a URI that all executors share); returns (path, part, docs, tokens).

    Files of ascending part hold ascending doc_id, null ones first; equal ids go by a hash of the text. A task writes under a name of its own
    attempt and reports it when it is whole, so what a lost or repeated attempt left is never read.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    sorted_rows = keyed.repartitionByRange("doc_id", "hash", "nth").sortWithinPartitions("doc_id", "hash", "nth")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        path, out, ids = f"{base}/{uuid.uuid4().hex}.dac", None, []
        for b in batches:
            if out is None and b.num_rows:
                where.create_dir(base, recursive=True)
                out = where.open_output_stream(path, compression=None)
                writer, known = Writer(out), shared(f"pieces of {tokenizer}", lambda: Pieces(tokenizer))
            if b.num_rows:
                ids.append(b.column("doc_id"))
            for text in b.column("text"):
                writer.add(known.encode(text.as_py()))
        if out is not None:
            writer.close(ids)
            out.close()
            done = [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"], [TaskContext.get().partitionId()], [len(writer.sizes)], [writer.n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], ["path", "part", "docs", "tokens"])

    return cut(sorted_rows.select("doc_id", "text").mapInArrow(write, "path string, part long, docs long, tokens long"))


def read_files(docs_type: str, files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    found = sorted(files.select("part", "path", "tokens").collect())  # a row for each file
    starts = np.cumsum([0, *(r.tokens for r in found)]).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                where, path = _open(uri)
                with where.open_input_file(path) as f:
                    reader = Reader(f, f.size())
                    sizes = reader.docs["n_tokens"].to_numpy()
                    ends = np.cumsum(sizes)
                    crcs = np.zeros(len(sizes), np.int64)
                    for a in range(0, reader.n, PIECE):
                        data = memoryview(reader.tokens(a, z := min(reader.n, a + PIECE)).tobytes())
                        for d in range(np.searchsorted(ends, a, side="right"), np.searchsorted(ends, z) + 1):
                            low, high = max(a, int(ends[d] - sizes[d])), min(z, int(ends[d]))
                            crcs[d] = zlib.crc32(data[4 * (low - a) : 4 * (high - a)], int(crcs[d]))
                    table = reader.docs.select(["doc_id"]).append_column("start", pa.array(start + ends - sizes)).append_column("n_tokens", reader.docs["n_tokens"]).append_column("ids_crc32", pa.array(crcs))
                    yield from table.to_batches()

    spark = files.sparkSession
    rows = spark.createDataFrame([(r.path, s) for r, s in zip(found, starts)], "path string, start long")
    return rows.repartition(max(1, len(found)), "path").mapInArrow(read, f"doc_id {docs_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes texts, writes their ids into files and reads these back: doc_id, start, n_tokens (with END), ids_crc32.

    tokenizer: path of a tokenizer file, on every worker. Null and empty texts have END alone. Documents go by ascending doc_id, null ids
    first; equal ids by a hash of the text, so rows that are equal in both can't be told apart. Texts are encoded whole, however
    long, in pieces that can't influence each other, and lie across segments where need be. An empty table gives an empty
    result. Other columns are ignored.
    """
    folder = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_files(docs.schema["doc_id"].dataType.simpleString(), write_files(docs, tokenizer, folder))

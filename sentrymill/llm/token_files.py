"""Token-ID files of directly addressable codes.

An id is cut into chunks of fixed widths, lowest bits first. Level 0 holds the first chunk of
every id, level 1 the second chunk of the ids that need one, and so on. A bitmap on each
level tells which ids go on; a rank directory (a count per 512 bits) turns the position on
one level into the position on the next. So any token is found from its index alone, by a
few reads at known offsets, without decoding a block.

File layout, little-endian, sections aligned to 8 bytes:

    magic "DACTOK01", u32 levels, u32 documents flag (0), u64 tokens, u64 documents
    per level: u64 width in bits, u64 items, u64 offset of chunks, of bitmap, of directory
    u64 offset of document ids (i64), of null flags (u8), of document starts (u64, documents + 1)
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count, islice
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder
from .text import file_system, filled, runs, steps

MAGIC = b"DACTOK01"
HEAD = np.dtype([("magic", "S8"), ("levels", "<u4"), ("flag", "<u4"), ("tokens", "<u8"), ("docs", "<u8")])
LEVEL = np.dtype([("width", "<u8"), ("items", "<u8"), ("chunks", "<u8"), ("bits", "<u8"), ("ranks", "<u8")])
# Bits that one entry of a rank directory covers.
RANK_BITS = 512
# Chunk widths in bits: a byte-aligned width for each level; levels no id reaches are left out.
WIDTHS = (8, 8, 16)
# A file is closed after the documents that bring it to so many tokens.
SHARD_TOKENS = 1 << 22
# Distinct words whose ids a task remembers; those of one more stretch of texts may come on top.
REMEMBERED_WORDS = 1 << 19

MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


# ---- the code itself ---------------------------------------------------------------------


def encode(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, starts: np.ndarray, widths=WIDTHS) -> bytes:
    """One file's bytes: all ids of its documents and where each document starts."""
    sections: list[bytes] = []
    levels = []
    rest = ids.astype(np.uint32)
    for k, width in enumerate(widths):
        chunk = (rest & np.uint32((1 << width) - 1)).astype(f"<u{width // 8}")
        rest = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        goes_on = rest != 0
        levels.append((width, len(chunk)))
        sections += [chunk.tobytes(), *_bitmap(goes_on)]
        rest = rest[goes_on]
        if not len(rest):
            break
    else:
        if len(rest):
            raise ValueError("an id needs more bits than the chunk widths hold")
    sections += [doc_ids.astype("<i8").tobytes(), doc_null.astype("u1").tobytes(), starts.astype("<u8").tobytes()]
    at = HEAD.itemsize + LEVEL.itemsize * len(levels) + 24
    offsets, body = [], []
    for s in sections:
        offsets.append(at)
        pad = -len(s) % 8
        body.append(s + b"\0" * pad)
        at += len(s) + pad
    head = np.array([(MAGIC, len(levels), 0, len(ids), len(doc_ids))], HEAD).tobytes()
    table = np.array([(w, n, *offsets[3 * k:3 * k + 3]) for k, (w, n) in enumerate(levels)], LEVEL).tobytes()
    return b"".join([head, table, np.array(offsets[-3:], "<u8").tobytes(), *body])


def _bitmap(flags: np.ndarray) -> tuple[bytes, bytes]:
    """The bits in whole blocks, and the ones before each block (and after the last)."""
    padded = np.zeros(-(-max(1, len(flags)) // RANK_BITS) * RANK_BITS, bool)
    padded[:len(flags)] = flags
    per_block = padded.reshape(-1, RANK_BITS).sum(1, dtype=np.int64)
    ranks = np.concatenate(([0], np.cumsum(per_block)))
    return np.packbits(padded, bitorder="little").tobytes(), ranks.astype("<u8").tobytes()


class TokenFile:
    """Random access to the tokens of one file; ``data`` is its bytes or a memory map."""

    def __init__(self, data):
        self.data = data
        head = np.frombuffer(data, HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, n_docs, n_levels = int(head["tokens"]), int(head["docs"]), int(head["levels"])
        table = np.frombuffer(data, LEVEL, n_levels, HEAD.itemsize)
        at = np.frombuffer(data, "<u8", 3, HEAD.itemsize + LEVEL.itemsize * n_levels)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, int(at[0]))
        self.doc_null = np.frombuffer(data, "u1", n_docs, int(at[1])).astype(bool)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, int(at[2])).astype(np.int64)
        self.levels = []
        for x in table:
            blocks = -(-max(1, int(x["items"])) // RANK_BITS)
            self.levels.append((
                int(x["width"]),
                np.frombuffer(data, f"<u{int(x['width']) // 8}", int(x["items"]), int(x["chunks"])),
                np.frombuffer(data, "<u8", blocks * RANK_BITS // 64, int(x["bits"])),
                np.frombuffer(data, "<u8", blocks + 1, int(x["ranks"])),
            ))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Ones before position i: the directory's count and those of at most eight words."""
        block = i // RANK_BITS
        out = ranks[block].astype(np.int64)
        word, per = i // 64, RANK_BITS // 64
        for k in range(per - 1):
            w = block * per + k
            out += np.where(w < word, np.bitwise_count(bits[np.minimum(w, len(bits) - 1)]), 0)
        below = (np.uint64(1) << (i % 64).astype(np.uint64)) - np.uint64(1)
        tail = np.minimum(word, len(bits) - 1)
        return out + np.where(word < len(bits), np.bitwise_count(bits[tail] & below), 0)

    def take(self, index) -> np.ndarray:
        """The tokens at any indexes, each found on its own."""
        i = np.atleast_1d(np.asarray(index, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n_tokens):
            raise IndexError("token index out of range")
        out = np.zeros(len(i), np.uint32)
        where, shift = np.arange(len(i)), 0
        for width, chunks, bits, ranks in self.levels:
            out[where] |= chunks[i].astype(np.uint32) << np.uint32(shift)
            goes_on = (bits[i // 64] >> (i % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            where, i, shift = where[goes_on], i[goes_on], shift + width
            if not len(i):
                break
            i = self._rank(bits, ranks, i)
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b: on each level they stand in a row."""
        return self._slice(0, a, b)

    def _slice(self, level: int, a: int, b: int) -> np.ndarray:
        width, chunks, bits, ranks = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        if b > a and level + 1 < len(self.levels):
            flags = np.unpackbits(bits[a // 64:-(-b // 64)].view("u1"), bitorder="little")
            goes_on = flags[a % 64:a % 64 + b - a].astype(bool)
            more = int(goes_on.sum())
            if more:
                first = int(self._rank(bits, ranks, np.array([a]))[0])
                out[goes_on] |= self._slice(level + 1, first, first + more) << np.uint32(width)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


# ---- text to ids -------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts, by encoding each distinct word of a stretch of texts once.

    Exact for tokenizers that never join characters across ASCII white space, such as those
    that split on it before they apply merges; ``whole_texts`` encodes text by text instead.
    Where the tokenizer lower-cases, splits letters from the punctuation after them, and takes a
    run of letters as one piece (all tried out at the start), words that differ in case or
    closing punctuation share the work, and words of a-z and the letters of Latin-1 go to the merges
    directly, many in a row, told apart by the mark that ids at the end of a word bear.
    """

    TAILS = ".,;:!?#$%&*"
    ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    LETTERS = re.compile("[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")

    def __init__(self, tokenizer_path: str, end_id: int | None, whole_texts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(tokenizer_path)
        self.end = [] if end_id is None else [end_id]
        self.whole_texts = whole_texts
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        pieces = (lambda x: [w for w, _ in t.pre_tokenizer.pre_tokenize_str(x)]) if t.pre_tokenizer else lambda x: []
        self.lowers = t.normalizer is not None and t.normalizer.normalize_str(upper) == upper.lower()
        self.splits = all(pieces(f"ab{c}{d}") == ["ab", f"{c}{d}"] for c in self.TAILS for d in self.TAILS)
        self.plain, suffix = None, getattr(t.model, "end_of_word_suffix", None)
        if suffix and self.lowers and pieces(upper.lower() * 2) == [upper.lower() * 2] and pieces("s t re ve m ll d") == "s t re ve m ll d".split():
            self.plain = Tokenizer(t.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = t.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
            self.closes[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
            self.letters = self._letters(pieces, vocabulary, suffix)
        self._forget()

    def _letters(self, pieces, vocabulary: dict, suffix: str) -> dict[int, str]:
        """What the merges see of each accented letter of Latin-1, where that is the same wherever it stands."""
        found = {c: pieces(self.tokenizer.normalizer.normalize_str(c)) for c in self.ACCENTED}
        seen = "".join(x for p in found.values() for x in p)
        apart = self.ACCENTED[::2] + "ab" + self.ACCENTED
        whole = "".join("".join(found.get(c, [c])) for c in apart)
        if (all(len(p) == 1 for p in found.values()) and not any(c.isspace() for c in seen)
                and all(c in vocabulary and c + suffix in vocabulary for c in seen)
                and pieces(self.tokenizer.normalizer.normalize_str(apart)) == [whole]):
            return {ord(c): p[0] for c, p in found.items()}
        return {}

    def _forget(self) -> None:
        """Words are two parts each; part 0 is empty, part 1 the end. Word 0 is the end. Words and parts are
        numbered as they are first looked up."""
        self.known: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.words = np.array([[1, 0]], np.int64)
        self.parts: defaultdict[str, int] = defaultdict(count(2).__next__, {"": 0})
        self.ids = np.array(self.end, np.uint32)
        self.at = np.array([0, 0], np.int64)
        self.length = np.array([0, len(self.end)], np.int64)

    def _encode_parts(self, fresh: list[str]) -> None:
        """Ids of the newest parts."""
        if self.plain is None:
            direct = [False] * len(fresh)
        elif self.letters:
            direct = [m is not None for m in map(self.LETTERS.fullmatch, fresh)]
        else:
            direct = [p.isascii() and p.isalpha() for p in fresh]
        plain, other = list(compress(fresh, direct)), list(compress(fresh, map(not_, direct)))
        ids, lengths = [self.ids], []
        groups = [plain[k:k + 500] for k in range(0, len(plain), 500)]
        joined = [" ".join(g).translate(self.letters) for g in groups]
        for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) if groups else ():
            ids.append(np.array(e.ids, np.uint32))
            lengths.append(np.diff(np.flatnonzero(self.closes[ids[-1]]), prepend=-1))
        for k in range(0, len(other), 20_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(other[k:k + 20_000], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        sizes = np.concatenate(lengths)
        places = np.argsort(~np.array(direct), kind="stable")  # those encoded first come first
        at, length = np.empty((2, len(fresh)), np.int64)
        at[places], length[places] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.ids = np.concatenate(ids)
        self.at, self.length = np.concatenate((self.at, at)), np.concatenate((self.length, length))

    def _learn(self, fresh: list[bytes]) -> None:
        joined = b"\n".join(fresh)  # words have no line breaks
        heads = (joined.lower() if self.lowers else joined).decode().split("\n")
        tails = [""] * len(heads)
        if self.splits:
            for k, w in enumerate(heads):
                if w[-1] in self.TAILS:
                    head = w.rstrip(self.TAILS)
                    if head and head[-1].isalpha():
                        heads[k], tails[k] = head, w[len(head):]
        place, n, before = self.parts.__getitem__, len(fresh), len(self.parts)
        pairs = np.stack((np.fromiter(map(place, heads), np.int64, n), np.fromiter(map(place, tails), np.int64, n)), 1)
        new = list(islice(self.parts, before, None))
        if new:
            self._encode_parts(new)
        self.words = np.concatenate((self.words, pairs))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; the end id closes each text."""
        if self.whole_texts:
            found = [e.ids + self.end for e in self.tokenizer.encode_batch_fast(
                [t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.array(list(map(len, found)), np.int64)
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        words = [t.split() for t in texts]  # bytes.split() splits on ASCII white space alone
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        before, n = len(self.known), int(last[-1]) if len(last) else 0
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, n)
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        parts = self.words[np.insert(which, last, 0)].ravel()
        ends = 2 * (last + np.arange(1, len(last) + 1))
        lengths = self.length[parts]
        through = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], ends))]
        kept = lengths > 0
        parts, lengths = parts[kept], lengths[kept]
        return self.ids[np.repeat(self.at[parts], lengths) + runs(lengths)], np.diff(through)


# ---- Spark -------------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: list | None = None,
    end_id: int | None = 1,
    shard_tokens: int = SHARD_TOKENS,
    widths: tuple[int, ...] = WIDTHS,
    whole_texts: bool = False,
) -> DataFrame:
    """Encode every text and write token files; returns the manifest, one row per file.

    Documents go to the files in the order of the columns ``order`` (by default the id, nulls
    first; rows of equal order by a hash of their text). The manifest, a Parquet table in
    ``folder``, names the files that belong to the result and the index ``start`` of their
    first token; a file left by a failed attempt has another name and is in no manifest. Null
    and empty texts give only the end id. An empty table gives an empty manifest.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        *[(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order or [id_col])],
    )
    keys = [F.col(c) for c in docs.columns[2:]] + [F.xxhash64("text")]

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, end_id, whole_texts)
        fs, base = file_system(folder)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            ids = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            starts = np.concatenate(([0], np.cumsum(lengths)))
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            data = encode(ids, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), starts, widths)
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            held.clear()
            seq += 1
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq - 1], pa.int32()), "file": [name],
                "n_docs": [len(lengths)], "n_tokens": [len(ids)],
            })

        for batch in steps(batches, "text", min(4 << 20, 2 * shard_tokens)):
            texts = filled(batch.column("text")).cast(pa.large_binary()).to_pylist()
            ids, lengths = encoder(texts)
            id_values = batch.column("id")
            held.append((
                ids, lengths, pc.fill_null(id_values, 0).to_numpy(zero_copy_only=False),
                pc.is_null(id_values).to_numpy(zero_copy_only=False),
            ))
            if sum(len(h[0]) for h in held) >= shard_tokens:
                yield flush()
        if held:
            yield flush()

    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    manifest = f"{folder}/manifest"
    (
        docs.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
        .mapInArrow(encode_part, MANIFEST).write.parquet(manifest)
    )
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark, folder: str) -> DataFrame:
    """The files of a folder with the index of their first token in the whole corpus.

    Sums per write task come first, so the ordered sum over all of them has as many rows as
    there were tasks, not as there are files.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens")).select(
        "part", F.coalesce(before, F.lit(0)).alias("part_start"))
    in_part = F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.join(parts, "part").select(
        "part", "seq", F.concat(F.lit(folder + "/"), "file").alias("file"), "n_docs", "n_tokens",
        (F.col("part_start") + F.coalesce(in_part, F.lit(0))).alias("start"),
    )


def open_token_file(path: str) -> TokenFile:
    fs, base = file_system(path)
    with fs.open_input_file(base) as f:
        return TokenFile(f.read())


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read every file back: each document's id, first token index, token count and crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                tokens = open_token_file(path)
                body = memoryview(tokens.slice(0, tokens.n_tokens).astype("<u4").tobytes())
                ends = (tokens.starts * 4).tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(tokens.doc_ids, pa.int64(), mask=tokens.doc_null),
                    "start": pa.array(tokens.starts[:-1] + start, pa.int64()),
                    "n_tokens": pa.array(np.diff(tokens.starts), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(body[a:b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                })

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_documents(write_token_files(docs, folder, tokenizer_path, **options))

"""Token ids in a fixed-width bit-packed block format.

Every id takes the fewest bits that hold the vocabulary. A file is a Parquet file of blocks; a block holds a run
of documents in ascending doc_id order: their ids, the offset of each document's first token in the block, and the
packed payload. Blocks start on a byte, so a block unpacks with numpy alone and any document, or any token by its
number, is reached through the offsets. A manifest holds, per file, the number of tokens before it.
Spark's own committer writes the files, so a lost executor or a repeated task leaves no part of a file behind.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import left_behind, ragged, shared_dir, steps, tidy

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: A block is closed once it holds this many tokens; one longer document is a block of its own.
BLOCK_TOKENS = 65_536
#: Words whose ids a Python worker remembers (about 60 MB); once it is full, words met in one group only are forgotten.
REMEMBERED = 250_000
#: New words are encoded so many at once, with a control character between them.
WORDS_AT_ONCE, SEPARATOR = 512, "\x01"
#: A letter of Latin-1 and the ASCII punctuation after it; words of ASCII and letters of Latin-1, without marks to compose.
PUNCTUATED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
PLAIN = r"^[\x{0}-\x{7f}À-ÖØ-öø-ÿ]*$"
#: Fixed value: the pattern of word_bpe_49k.json, of which the shortcuts of ``WordEncoder`` are known to be exact.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Ids packed or unpacked in one step, a multiple of eight.
AT_ONCE = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-bit numbers, the lowest bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    spread = lambda part: ((part.astype(np.uint32)[:, None] >> places) & np.uint32(1)).astype(np.uint8)
    # A multiple of eight ids ends on a byte.
    return b"".join(np.packbits(spread(ids[at : at + AT_ONCE]).ravel(), bitorder="little").tobytes() for at in range(0, len(ids), AT_ONCE))


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from number ``start`` on; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    out = np.empty(count, np.uint32)
    places = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    for at in range(0, count, AT_ONCE):
        begin, n = start + at, min(AT_ONCE, count - at)
        first, last = begin * bits // 8, -(-(begin + n) * bits // 8)
        flat = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
        out[at : at + n] = flat[begin * bits - first * 8 :][: n * bits].reshape(n, bits).astype(np.uint32) @ places
    return out


def _spec(part) -> dict:
    """A tokenizer's description of one of its parts; of the part only, as the whole holds the vocabulary."""
    return json.loads(part.__getstate__()) if part is not None else {}


def _by_words(pre_tokenizer: dict, normalizer: dict) -> bool:
    """Whether a tokenizer's own description says that it treats the words of a text one by one.

    That holds where its first pre-tokenizer splits at white space or keeps only the matches of WORDS, in which no match
    holds white space, and its normalizer works within words.
    """
    flat = lambda x, many: x.get(many, [x]) if x else []
    first = (flat(pre_tokenizer, "pretokenizers") or [{}])[0]
    inside = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "BertNormalizer", "StripAccents"}
    local = all(n.get("type") in inside or (n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " ") for n in flat(normalizer, "normalizers"))
    return local and (first.get("type") in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit") or _keeps_words(first))


def _keeps_words(first: dict) -> bool:
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and first.get("pattern") == {"Regex": WORDS}


class WordEncoder:
    """Encodes whole texts through a memory of words.

    For a tokenizer that drops white space and never merges across it, the ids of a text are those of its words
    in order. Control characters other than white space, and white space beyond ASCII, stay inside a word and are
    left to the tokenizer. Any other tokenizer gets whole texts.

    Where it keeps the matches of WORDS of lower-cased NFC text, one entry serves "word", "Word" and "word,":

    - Words are cut between a letter of Latin-1 and ASCII punctuation. NFC never composes across an ASCII character and
      leaves these letters as they are, the lower case of each is one of them, and no match of WORDS goes on from a
      letter into punctuation. Texts that hold a special string, in any case, or a capital sigma, whose lower case may
      depend on what is beside it, are not cut.
    - Words that hold only ASCII and letters of Latin-1, and no special string, are lower-cased: NFC changes nothing
      in them, before or after. In others a small letter could compose with a mark that the capital does not compose with.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre, normal = _spec(self.tokenizer.pre_tokenizer), _spec(self.tokenizer.normalizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = _by_words(pre, normal) and not any(c.isspace() for t in self.special for c in t)
        kinds = [n.get("type") for n in normal.get("normalizers", [normal])]
        self.cuts = self.by_words and kinds == ["NFC", "Replace", "Lowercase"] and len(self.special) <= 8 and _keeps_words((pre.get("pretokenizers") or [pre])[0])
        own = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = own[0] if len(own) == 1 else None
        self.memory: dict[str, int] = {}
        # By a word's number: its ids' place in ``flat``, how many there are, and in how many groups it was met.
        self.begin, self.count, self.met = (np.empty(0, np.int64) for _ in range(3))
        self.flat = np.empty(0, "<u4")

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has).

        One call takes many words, with a separator between them that has an id of its own. Where the ids do not
        hold it once between any two words (some word has that character), each word is encoded by itself.
        """
        flats, counts = [], []
        chunks = [words[at : at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
        between = f" {SEPARATOR} "
        joined = self.tokenizer.encode_batch_fast([between.join(c) for c in chunks], add_special_tokens=False) if self.separator is not None else [None] * len(chunks)
        for chunk, e in zip(chunks, joined, strict=True):
            ids = np.asarray(e.ids if e else [], "<u4")
            cuts = np.flatnonzero(ids == self.separator) if e else ids
            if len(cuts) == len(chunk) - 1 and e:
                counts.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                flats.append(np.delete(ids, cuts))
            else:
                own = [x.ids for x in self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False)]
                counts.append(np.fromiter(map(len, own), np.int64, len(own)))
                flats.append(np.fromiter(chain.from_iterable(own), "<u4", counts[-1].sum()))
        return np.concatenate(flats), np.concatenate(counts)

    def _make_room(self, coming: int) -> None:
        """Forget the words met in one group only; all words, if that leaves the memory over half full."""
        if len(self.memory) + coming <= REMEMBERED:
            return
        keep = self.met > 1
        if keep.sum() + coming > REMEMBERED // 2:
            keep[:] = False
        self.memory = {w: k for k, w in enumerate([w for w, stays in zip(self.memory, keep.tolist(), strict=True) if stays])}
        self.flat = self.flat[ragged(self.begin[keep], self.count[keep])]
        self.count, self.met = self.count[keep], self.met[keep]
        self.begin = np.cumsum(self.count) - self.count

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words; those that are new are encoded."""
        new = [w for w in words if w not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self._make_room(len(new))
            new = [w for w in words if w not in self.memory]
        if new:
            flat, count = self._encode_words(new)
            self.memory.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.flat = np.concatenate([self.flat, flat])
            self.count, self.met = np.concatenate([self.count, count]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
        rows = np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))
        self.met[rows] += 1
        return rows

    def _special(self, strings: pa.Array) -> pa.Array:
        """Whether each holds a special string, in any case."""
        held = pa.array(np.zeros(len(strings), bool))
        for content in self.special:
            held = pc.or_(held, pc.match_substring(strings, content, ignore_case=True))
        return held

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if not self.by_words:
            return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        column = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), "\t", " ")
        if self.cuts:
            odd = pc.or_(pc.match_substring(column, "\u03a3"), self._special(column))
            column = pc.if_else(odd, column, pc.replace_substring_regex(column, PUNCTUATED, r"\1 \2"))
        split = pc.split_pattern(column, " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        if self.cuts:
            lowers = pc.and_not(pc.match_substring_regex(distinct, PLAIN), self._special(distinct))
            distinct = pc.if_else(lowers, pc.utf8_lower(distinct), distinct)
        forms = distinct.dictionary_encode()
        row = self._numbers(forms.dictionary.to_pylist())[forms.indices.to_numpy()][words.indices.to_numpy()]
        count = self.count[row]
        ids = self.flat[ragged(self.begin[row], count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(pc.list_value_length(split).to_numpy())]
        return np.split(ids, ends[:-1])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, so its memory outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file is; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, partitions: int | None = None) -> None:
    """Write doc_id and text as packed blocks below ``path``: ``blocks`` and ``manifest``.

    Ascending doc_id; rows with equal doc_id follow one another in the order of their texts, null doc_ids come
    first. A null text is an empty document: its end id only. An empty table gives files without blocks. Other columns
    are ignored; doc_id keeps its type. A block tells its least and greatest doc_id, so that a reader in search of one
    document skips the others.
    """
    where = tokenizer_path(tokenizer)
    bits = bits_for(max(vocabulary_size(where), end_id + 1))
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, block int, bits int, n_tokens long, first_id {kind}, last_id {kind}, doc_ids array<{kind}>, offsets array<bigint>, payload binary"
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, ids, doc_ids, offsets, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block(key: pa.DataType) -> pa.RecordBatch:
            known = [d for d in doc_ids if d is not None]
            row = [[part], [number], [bits], [held], known[:1] or [None], known[-1:] or [None], [doc_ids], [offsets], [pack(np.concatenate(ids), bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), key, key, pa.list_(key), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "bits", "n_tokens", "first_id", "last_id", "doc_ids", "offsets", "payload"])

        own, end, key = encoder(where), np.asarray([end_id], "<u4"), None
        for batch in batches:
            key = batch.schema.field("doc_id").type
            for piece in steps(batch, "text", 512):
                texts = piece.column("text").to_pylist()
                for doc_id, tokens in zip(piece.column("doc_id").to_pylist(), own.encode([t or "" for t in texts]), strict=True):
                    if held and held + len(tokens) + 1 > block_tokens:
                        yield block(key)
                        number, ids, doc_ids, offsets, held = number + 1, [], [], [], 0
                    doc_ids.append(doc_id)
                    offsets.append(held)
                    ids += [tokens, end]
                    held += len(tokens) + 1
        if held:
            yield block(key)

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")
    counts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file: ``partitions`` rows
    counts.select("part", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["first_id"].dataType.simpleString()
    manifest = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("part_start"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("in_part"))
    index = index.join(manifest, "part").select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("part_start") + F.col("in_part")).alias("block_start"))

    @tidy
    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, "payload", 1):
                (row,) = piece.to_pylist()
                ids = unpack(row["payload"], row["bits"], 0, row["n_tokens"])
                ends = [*row["offsets"][1:], row["n_tokens"]]
                spans = list(zip(row["offsets"], ends, strict=True))
                cols = [[a for a, _ in spans], [b - a for a, b in spans], [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in spans]]
                n = len(spans)
                yield pa.record_batch([pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), piece.column("doc_ids").flatten(), *(pa.array(c, pa.int64()) for c in cols)], ["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32"])

    docs = blocks.select("part", "block", "bits", "n_tokens", "doc_ids", "offsets", "payload").mapInArrow(documents, f"part int, block int, doc_id {kind}, offset long, n_tokens long, ids_crc32 long")
    joined = docs.join(index, (docs["part"] == index["p"]) & (docs["block"] == index["b"]))
    return joined.select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(spark: SparkSession, path: str, doc_id) -> list[np.ndarray]:
    """Random access: the ids of a document (of each row with this doc_id), from the blocks that hold it.

    The range of ids per block is pushed down to the files, so other blocks' payloads are not read.
    """
    inside = (F.col("first_id") <= F.lit(doc_id)) & (F.col("last_id") >= F.lit(doc_id)) & F.array_contains("doc_ids", doc_id)
    rows = spark.read.parquet(f"{path}/blocks").filter(inside).orderBy("part", "block").collect()  # one block, unless the id is repeated
    found = []
    for r in rows:
        ends = [*r["offsets"][1:], r["n_tokens"]]
        found += [unpack(r["payload"], r["bits"], a, b - a) for d, a, b in zip(r["doc_ids"], r["offsets"], ends, strict=True) if d == doc_id]
    return found


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Write to a new folder that all executors share, then read the files back; the files stay, as the result is read from them, but in an ``owned`` block."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/millrace/tokens-{uuid.uuid4().hex}"
    left_behind(path)
    write(docs, path, **how)
    return read(spark, path)

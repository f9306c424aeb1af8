"""Alignment of two tokenizers over the same bytes, and how often the corpus links their ids.

A text is encoded by A and by B with a space before it. Byte offsets where tokens of both end cut it into groups; tokens
of A and B whose byte ranges overlap are linked. Per stream of tokens this is numpy alone: ``cumsum`` gives the ends,
``intersect1d`` the common cuts, ``searchsorted`` each token's group and the first and last partner, and a repeat
expands them to links.

1. One scan writes a row per document: its numbers of tokens, groups and links, the digest of its groups, and its distinct
   linked id pairs with their occurrences.
2. The documents that hold a pair are counted in two stages: tasks count what they read, then a shuffle on the pair and
   a salt, then one on the pair.
3. Documents meet their pairs' counts: by a broadcast up to BROADCAST_ROWS pairs, beyond that with the frequent pairs
   broadcast and the others shuffled.

Where both tokenizers say by their own description that they treat the parts of a text between single spaces one by one
(``by_parts``), each distinct part is encoded and aligned once per worker and remembered; its tokens end where it ends,
so no group or link crosses parts. A part that begins or ends with white space is never cut off.

Texts that are null or empty, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and an
empty digest. Special strings in a text are plain text. Repeated rows each count as a document; an empty table gives an
empty result; other columns are ignored; doc_id may be null or repeated. Very long texts are one row of ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup_join, own_names, quoted, ragged, steps, tidy

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct parts that a worker remembers, about 350 bytes each; once it is full, those met once are forgotten first.
REMEMBERED = 600_000
#: Pairs up to which their counts are broadcast (24 bytes each), and salts of the first stage of counting.
BROADCAST_ROWS, SALTS = 1_000_000, 16
#: Pairs that a task holds before it counts them.
COUNTED = 4_000_000
#: Where a text may be cut: a single space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space in the sense of ``str.isspace``, and parts that are empty or have some at an end.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"^$|^{_SPACE}|{_SPACE}$"
#: Parts that are encoded in one call, as a text of their own.
PARTS_AT_ONCE = 1000


def align(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(common ends, group of each A token, of each B token, the A and the B side of every link) of two streams over equal bytes."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(end_a, end_b)
    first = np.searchsorted(end_b, end_a - size_a, "right")
    count = np.searchsorted(end_b - size_b, end_a, "left") - first
    return cuts, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), np.repeat(np.arange(len(size_a)), count), ragged(first, count)


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """A of the alignment: a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of, vocabulary = byte_level(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.pieces[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        # Its pattern takes a single space with what follows, so words between single spaces do not meet.
        self.by_parts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and self.tokenizer.normalizer is None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class PieceTokenizer:
    """B of the alignment: a model of the sentencepiece library, which puts the space there itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.pieces = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(n)) and self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.by_parts = self._merges_within_parts(names)

    def _merges_within_parts(self, names: list[str]) -> bool:
        """Whether texts are taken as they are and no piece holds a space after another character, so none crosses one."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:  # without protobuf the model does not tell
            return False
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        normal, trained = proto.normalizer_spec, proto.trainer_spec
        plain = normal.name == "identity" and not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        return plain and trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix and not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Remembers the alignment of parts: what both tokenizers make of each, its groups and its links."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.by_parts = self.a.by_parts and self.b.by_parts
        self.numbers: dict[str, int] = {}
        self.digests: list[bytes] = []
        # Of each part: tokens of A and B, groups, whether both give its bytes back; its links' place and number; in how many steps it was met.
        self.facts = np.empty((0, 4), np.int64)
        self.begin, self.links, self.met = (np.empty(0, np.int64) for _ in range(3))
        self.pairs = np.empty(0, np.int64)

    def _encoded(self, parts: list[str], numbers: list[int], out: list[tuple]) -> None:
        """Appends (numbers, ids and counts of A, ids and counts of B) of those of ``parts`` that both give back.

        Several parts are encoded as one text, in which each must end with a token of both; where that does not give the
        bytes back, its halves are tried.
        """
        text = " ".join(parts)
        raw, found = f" {text}".encode(), []
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts)))
        for side in (self.a, self.b):
            (ids,) = side.encode([text])
            if b"".join([side.pieces[i] for i in ids]) != raw:
                break
            ids = np.array(ids, np.int64)
            token_ends = np.cumsum(side.sizes[ids])
            upto = np.searchsorted(token_ends, ends, "right")
            if (token_ends[upto - 1] != ends).any():
                break
            found += [ids, np.diff(upto, prepend=0)]
        else:
            out.append((numbers, *found))
            return
        if len(parts) > 1:
            half = len(parts) // 2
            self._encoded(parts[:half], numbers[:half], out)
            self._encoded(parts[half:], numbers[half:], out)

    def _aligned(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(facts, number of links, id pairs of the links, groups as text) of parts; the links in the order of the parts."""
        odd = pc.match_substring_regex(pa.array(parts, pa.large_string()), _ODD).to_pylist() if self.by_parts else [True] * len(parts)
        plain, out = [i for i, o in enumerate(odd) if not o], []
        for at in range(0, len(plain), PARTS_AT_ONCE):
            some = plain[at : at + PARTS_AT_ONCE]
            self._encoded([parts[i] for i in some], some, out)
        for i in (i for i, o in enumerate(odd) if o):
            self._encoded([parts[i]], [i], out)
        facts, links, text = np.zeros((len(parts), 4), np.int64), np.zeros(len(parts), np.int64), [b""] * len(parts)
        if not out:
            return facts, links, np.empty(0, np.int64), text
        kept, ids_a, n_a, ids_b, n_b = (np.concatenate(x) for x in zip(*out, strict=True))
        cuts, group_a, group_b, left, right = align(self.a.sizes[ids_a], self.b.sizes[ids_b])
        part_a = np.repeat(np.arange(len(kept)), n_a)
        per = np.bincount(part_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=len(kept))
        facts[kept] = np.stack([n_a, n_b, per, np.ones(len(kept), np.int64)], axis=1)
        count = np.bincount(part_a[left], minlength=len(kept))
        links[kept] = count
        bounds = lambda group: np.searchsorted(group, np.arange(len(cuts) + 1)).tolist()
        say_a, say_b, at_a, at_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist())), bounds(group_a), bounds(group_b)
        groups = [f"{','.join(say_a[a:c])}|{','.join(say_b[b:d])}" for a, c, b, d in zip(at_a, at_a[1:], at_b, at_b[1:], strict=False)]
        at = 0
        for i, n in zip(kept.tolist(), per.tolist(), strict=True):
            text[i] = ";".join(groups[at : at + n]).encode()
            at += n
        order = np.argsort(kept)
        pairs = (ids_a[left] << 32 | ids_b[right])[ragged((np.cumsum(count) - count)[order], count[order])]
        return facts, links, pairs, text

    def _forget(self, coming: int) -> None:
        keep = self.met > 1
        if keep.sum() + coming > REMEMBERED // 2:
            keep[:] = False
        stays = keep.tolist()
        self.numbers = {w: k for k, w in enumerate([w for w, s in zip(self.numbers, stays, strict=True) if s])}
        self.digests = [d for d, s in zip(self.digests, stays, strict=True) if s]
        self.pairs = self.pairs[ragged(self.begin[keep], self.links[keep])]
        self.facts, self.links, self.met = self.facts[keep], self.links[keep], self.met[keep]
        self.begin = np.cumsum(self.links) - self.links

    def rows(self, parts: list[str]) -> np.ndarray:
        """The numbers of distinct parts; new ones are aligned."""
        new = [p for p in parts if p not in self.numbers]
        if len(self.numbers) + len(new) > REMEMBERED:
            self._forget(len(new))
            new = [p for p in parts if p not in self.numbers]
        if new:
            facts, links, pairs, text = self._aligned(new)
            self.numbers.update(zip(new, range(len(self.links), len(self.links) + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, len(self.pairs) + np.cumsum(links) - links])
            self.pairs, self.facts, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.facts, facts]), np.concatenate([self.links, links])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.digests += text
        found = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        self.met[found] += 1
        return found

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the parts of each text, in order."""
        if not self.by_parts:
            every = list(dict.fromkeys(texts))
            of = dict(zip(every, self.rows(every).tolist(), strict=True))
            return [np.array([of[t]]) for t in texts]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        odd = np.array(pc.match_substring_regex(words.dictionary, _ODD).to_numpy(zero_copy_only=False), bool)
        held = np.concatenate([[0], np.cumsum(odd[words.indices.to_numpy()])])
        # Texts with such a part are cut where that is exact; of the others every part is one.
        again = {k: _CUT.split(texts[k]) for k in np.flatnonzero(np.diff(held[ends], prepend=0)).tolist()}
        parts = words.dictionary.to_pylist()
        known = set(parts)
        extra = [p for p in dict.fromkeys(chain.from_iterable(again.values())) if p not in known]
        rows = np.split(self.rows(parts + extra)[: len(parts)][words.indices.to_numpy()], ends[:-1])
        for k, own in again.items():
            rows[k] = np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own))
        return rows


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, so its memory outlives a task."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_FIELDS = ("n_a", "n_b", "n_groups", "n_links")


def documents(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """All columns but ``text`` of each row, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs (A id << 32 | B id) with their occurrences."""
    where = _path(tokenizer_a), _path(tokenizer_b)
    rest = [c for c in docs.columns if c != "text"]

    @tidy
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*where)
        for batch in batches:
            for piece in steps(batch, "text"):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                rows = own.of_texts(texts)
                facts, digests, pairs, times = np.zeros((len(texts), 4), np.int64), [], [], []
                for i, (text, r) in enumerate(zip(texts, rows, strict=True)):
                    if text and own.facts[r, 3].all():
                        found, n = np.unique(own.pairs[ragged(own.begin[r], own.links[r])], return_counts=True)
                        facts[i, :3], facts[i, 3] = own.facts[r, :3].sum(axis=0), n.sum()
                        digests.append(sha256(b";".join([own.digests[k] for k in r.tolist()])).hexdigest())
                        pairs.append(found)
                        times.append(n)
                    else:
                        digests.append("")
                        pairs.append([])
                        times.append([])
                cols = [*(piece.column(c) for c in rest), *(pa.array(facts[:, k]) for k in range(4)), pa.array(digests), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.record_batch(cols, [*rest, *_FIELDS, "groups_sha256", "pairs", "times"])

    kinds = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(scan, ", ".join([*kinds, *(f"{c} long" for c in _FIELDS), "groups_sha256 string", "pairs array<bigint>", "times array<int>"]))


@tidy
def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, salt and the number of the task's documents that hold it; tasks have different salts."""
    from pyspark import TaskContext

    held, size, salt = [], 0, TaskContext.get().partitionId() % SALTS

    def counted() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(pair), pa.array(np.full(len(pair), salt), pa.int32()), pa.array(n.astype(np.int64))], ["pair", "salt", "n"])

    for batch in batches:
        held.append(batch.column("pairs").flatten().to_numpy())
        size += len(held[-1])
        if size >= COUNTED:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and freq: how many documents hold it linked."""
    counts = rows.select("pairs").mapInArrow(_partial, "pair long, salt int, n long")
    return counts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("freq"))


def _with_best(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: whether no pair of the same A id is held by more documents."""
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("freq").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "freq", (F.col("freq") == F.col("most")).alias("best"))


def links(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """id_a, id_b and n_docs of every pair that some document links: the corpus-wide table of the two vocabularies."""
    with Scratch(docs.sparkSession, "token_align") as scratch:
        counts = pair_counts(documents(docs.select("text"), tokenizer_a, tokenizer_b))
        out = counts.select(F.shiftright("pair", 32).cast("int").alias("id_a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("id_b"), F.col("freq").alias("n_docs"))
        return scratch.settle(out, "links", keep=True)


def alignment(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    n_best: links whose pair is held by as many documents as any pair of its A id; count_sum: the documents that hold
    each link's pair, summed over the links.
    """
    (key,) = own_names(1)
    with Scratch(docs.sparkSession, "token_align") as scratch:
        keyed = docs.select("doc_id", "text").withColumn(key, F.monotonically_increasing_id())
        rows = scratch.settle(documents(keyed, tokenizer_a, tokenizer_b), "rows")
        counts = scratch.settle(pair_counts(rows), "counts")
        counts = scratch.settle(_with_best(counts), "counts")
        held = rows.select(key, F.arrays_zip("pairs", "times").alias("x")).select(key, F.inline("x")).withColumnRenamed("pairs", "pair")
        if counts.count() <= BROADCAST_ROWS:
            met = held.join(F.broadcast(counts), "pair")
        else:
            met = lookup_join(held, counts, "pair", int(counts.agg(F.sum("freq")).first()[0]))
        score = met.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("freq")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        out = rows.join(score, key, "left").select("doc_id", *_FIELDS, zero("n_best"), zero("count_sum"), "groups_sha256")
        return scratch.settle(out, "alignment", keep=True)

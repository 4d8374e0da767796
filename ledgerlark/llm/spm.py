"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The ``.model`` protobuf is parsed here (only the wire format is needed), and
the normaliser, the metaspace marker, the piece scores and the byte fallback
are rebuilt as a ``tokenizers`` pipeline.  Unigram models keep their piece
scores as they are; BPE models get their merge list from the scores, since in
such models the score only orders the merges.

Control and unused pieces are never made from text; user-defined pieces are cut
out of the normalised text first, as one piece each.

Every row is checked for parity: the ids of ``tokenizers`` are compared with
those of the ``sentencepiece`` library, text by text.  A differing row is
reported (``parity`` false); its ids are those of ``tokenizers`` all the same.
Known difference: literal byte pieces ("<0x41>") in texts of unigram models.

Defined results: null text -> null ids and decoded text, ``n_tokens`` 0 and
``parity`` true; empty text -> empty ids and empty text.  Extra columns,
repeated rows and null ids pass through unchanged.  An input column whose name
equals an output column is replaced by the output.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlark.llm.batches import bounded
from ledgerlark.llm.rows import unused

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MODEL = os.environ.get("LEDGERLARK_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def wire(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, buf[at : at + size]
        at += size


@dataclass
class SpmModel:
    """What encoding needs of a SentencePiece ``ModelProto``."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    charsmap: bytes = b""

    @classmethod
    def parse(cls, blob: bytes) -> SpmModel:
        model = cls()
        for number, value in wire(blob):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in wire(value):
                    if n == 1:
                        text = v.decode("utf-8")
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                model.pieces.append((text, score, kind))
            elif number == 2:
                spec = dict(wire(value))
                model.kind = spec.get(3, UNIGRAM)
                model.byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(wire(value))
                model.charsmap = spec.get(2, b"")
                model.add_dummy_prefix = bool(spec.get(3, 1))
                model.remove_extra = bool(spec.get(4, 1))
                model.escape = bool(spec.get(5, 1))
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError(f"unsupported SentencePiece model type {model.kind}")
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces whose concatenation is a piece, best score first."""
        rank = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        found = []
        for piece, score in rank.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in rank and right in rank:
                    found.append((-score, len(left), left, right))
        found.sort(key=lambda x: (x[0], x[1]))
        return [(left, right) for _, _, left, right in found]


def normaliser(model: SpmModel):
    """The model's normaliser and marker, or None."""
    from tokenizers import Regex, normalizers

    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps) if steps else None


def build(model: SpmModel):
    """A ``tokenizers.Tokenizer`` with the behaviour of the parsed model.

    With user-defined pieces it takes text that :func:`normaliser` has already
    changed: the library cuts such pieces out before it normalises, and would
    then put a marker before each part.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, models, pre_tokenizers

    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unk = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    user = [p for p, _, kind in model.pieces if kind == USER]
    if model.kind == BPE:
        core = models.BPE(vocab=ids, merges=model.merges(), unk_token=model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        # A space never occurs in normalised text: pieces that text must not give get one.
        hidden = (UNKNOWN, CONTROL, UNUSED)
        core = models.Unigram([(" " + p if kind in hidden else p, s) for p, s, kind in model.pieces], unk_id=unk, byte_fallback=model.byte_fallback)
    tok = Tokenizer(core)
    if user:
        tok.add_tokens([AddedToken(p, normalized=False, special=False) for p in user])
    elif (before := normaliser(model)) is not None:
        tok.normalizer = before
    if all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER)):
        # No piece runs on over a marker, so merging never crosses one: cut the
        # text before each run of markers and let the word cache do the rest.
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tok.decoder = _tail(model.add_dummy_prefix)
    return tok


def _tail(strip: bool):
    """Markers to spaces, byte pieces to characters; ``strip`` takes the leading space away."""
    from tokenizers import decoders

    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if strip:
        steps.append(decoders.Strip(content=" ", left=1, right=0))
    return decoders.Sequence(steps)


CACHE_WORDS = 500_000
LINE_WORDS = 256
#: Stands for a byte piece in the table of decoded pieces.
RAW = "\ufffe"


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[start:start + size], one after another."""
    to = np.cumsum(size)
    return flat[np.repeat(start - to + size, size) + np.arange(to[-1] if len(to) else 0)]


class Growing:
    """Stretches of one flat array that grows."""

    def __init__(self, kind):
        self.flat, self.start, self.size = np.zeros(1 << 20, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start = np.append(self.start, self.used + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.used += len(flat)


class Codec:
    """Encodes and decodes batches; words already seen come from a bounded cache.

    Merging never crosses a marker (see :func:`build`), nor a line feed if no
    piece has one, so a text's ids are the ids of its words in turn.  Words not
    in the cache are encoded together, in lines of words between line feeds,
    by one multithreaded ``encode_batch`` call.  Models whose pieces do cross
    markers are encoded text by text instead.  The cache starts anew beyond
    ``CACHE_WORDS`` words.
    """

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, "rb") as f:
            blob = f.read()
        self.model = SpmModel.parse(blob)
        self.tok = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.words = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        # The normaliser adds nothing but the marker: words can be cut here.
        plain = self.tok.pre_tokenizer is not None and self.model.escape and self.model.kind == BPE
        plain = plain and not self.model.charsmap and not self.model.remove_extra
        plain = plain and self.model.byte_fallback and all("\n" not in p and kind != USER for p, _, kind in self.model.pieces)
        feed = self.tok.encode_batch_fast(["\n"], add_special_tokens=False)[0].ids if plain else []
        self.by_word = bool(feed) and self.model.pieces[feed[-1]][2] == BYTE
        self.before = normaliser(self.model) if any(kind == USER for _, _, kind in self.model.pieces) else None
        self.silent = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}
        if self.by_word:
            self.feed = feed[-1]
            self.bare = Tokenizer(self.tok.model)
            self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
            self.bare.decoder = _tail(False)
            single = self.bare.decode_batch([[i] for i in range(len(self.model.pieces))], skip_special_tokens=False)
            self.table = [RAW if kind == BYTE else d for d, (_, _, kind) in zip(single, self.model.pieces, strict=True)]
            self.table[self.feed] = "\n"
            self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"\n": 0}
        self.word_ids, self.word_text = Growing(np.int32), Growing(np.uint8)
        self.word_ids.add(np.array([self.feed], np.int32), np.array([1]))
        self.word_text.add(np.array([10], np.uint8), np.array([1]))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids (int32), and the bytes of the text that the ids decode to, for each text."""
        if not self.by_word:
            if self.before is not None:
                texts = [self.before.normalize_str(t) for t in texts]
            found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return [np.array(i, np.int32) for i in found], [d.encode() for d in self.decode(found)]
        lead = MARK if self.model.add_dummy_prefix else ""
        cut = [self.words(lead + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.clear()
        flat = list(chain.from_iterable(cut))
        which = list(map(self.index.get, flat))
        new = [k for k, i in enumerate(which) if i is None]
        if new:
            self.learn(list({flat[k] for k in new}))
            for k in new:
                which[k] = self.index[flat[k]]
        pick = np.array(which, np.int64)
        edge = np.cumsum([0, *map(len, cut)])

        def stretches(words: Growing) -> list[np.ndarray]:
            size = words.size[pick]
            to = np.append(0, np.cumsum(size))[edge]
            all_ = ragged(words.flat, words.start[pick], size)
            return [all_[a:b] for a, b in zip(to, to[1:], strict=False)]

        back = [t.tobytes() for t in stretches(self.word_text)]
        return stretches(self.word_ids), [t[1:] if lead and t[:1] == b" " else t for t in back]

    def learn(self, words: list[str]) -> None:
        """Puts the ids and decoded texts of new words (without line feeds) into the cache."""
        lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        text: list[bytes] = []
        ids, sizes = [], []
        for line, found in zip(lines, self.bare.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False), strict=True):
            own = found.ids
            array = np.array(own, np.int32)
            cuts = np.flatnonzero(array == self.feed)
            sizes.append(np.diff(cuts, prepend=-1, append=len(array)) - 1)
            ids.append(array[array != self.feed])
            joined = "".join(map(self.table.__getitem__, own))
            got = joined.split("\n")
            if RAW in joined:
                to = [0, *(cuts + 1).tolist(), len(own) + 1]
                got = [self.bare.decode(own[to[k] : to[k + 1] - 1], skip_special_tokens=False) if RAW in g else g for k, g in enumerate(got)]
            text += [g.encode() for g in got]
        for w in words:
            self.index[w] = len(self.index)
        self.word_ids.add(np.concatenate(ids), np.concatenate(sizes))
        self.word_text.add(np.frombuffer(b"".join(text), np.uint8), np.array(list(map(len, text)), np.int64))

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of ids; control pieces have none."""
        return self.tok.decode_batch([[i for i in row if i not in self.silent] for row in ids], skip_special_tokens=False)

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes], list[bool]]:
        """Ids, decoded texts, and whether sentencepiece gives the same ids."""
        ids, back = self.encode(texts)
        want = self.reference.encode(texts, num_threads=1)
        return ids, back, [len(a) == len(b) and bool((a == np.array(b, np.int32)).all()) for a, b in zip(ids, want, strict=True)]


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int) -> Codec:
    """One codec for each Python worker."""
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads)
    return _codecs[path, threads]


SLICE_BYTES = 2 << 20
FULL = "ids array<int>, n_tokens long, decoded string, parity boolean"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, threads: int = 2, digest: bool = False) -> DataFrame:
    """``docs`` with ids, token count, decoded text and parity of its texts.

    ``digest`` replaces ids and decoded text by SHA-256 values (ids as
    little-endian int32) and a flag that says whether decoding gave the text
    back.  Rows are independent: no shuffle, memory bounded by one slice of
    texts and the word cache.
    """
    added = T._parse_datatype_string(DIGEST if digest else FULL)
    carry = [c for c in docs.columns if c not in added.names and not (digest and c == text)]
    body = unused(docs, "__text")
    source = docs.select(*[docs[c] for c in carry], docs[text].alias(body))
    schema = T.StructType([source.schema[c] for c in carry] + list(added))

    def run(batches):
        code = codec(path, threads)
        for batch in batches:
            at, column, size = 0, batch.column(body), batch.num_rows
            while at < size:
                texts, weight = [], 0
                while at + len(texts) < size and weight < SLICE_BYTES:
                    texts.append(column[at + len(texts)].as_py())
                    weight += len(texts[-1] or "") + 16
                null = [t is None for t in texts]
                ids, back, same = code.checked([t or "" for t in texts])
                new = [pa.array([len(i) for i in ids], pa.int64())]
                if digest:
                    new += [
                        pa.array([None if n else hashlib.sha256(i.astype("<i4", copy=False).tobytes()).hexdigest() for n, i in zip(null, ids, strict=True)], pa.string()),
                        pa.array([None if n else hashlib.sha256(d).hexdigest() for n, d in zip(null, back, strict=True)], pa.string()),
                        pa.array([n or d == t.encode() for n, d, t in zip(null, back, texts, strict=True)], pa.bool_()),
                    ]
                else:
                    at_ = pa.array(np.append(0, np.cumsum([len(i) for i in ids])), pa.int32())
                    lists = pa.ListArray.from_arrays(at_, pa.array(np.concatenate(ids)), mask=pa.array(null))
                    new = [lists, *new, pa.array([None if n else d.decode() for n, d in zip(null, back, strict=True)], pa.string())]
                new.append(pa.array(same, pa.bool_()))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + new, names=schema.names)
                at += len(texts)

    return bounded(source).mapInArrow(run, schema)


def decode(frame: DataFrame, ids: str = "ids", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """``frame`` with the text of its id arrays; null ids -> null."""
    carry = [c for c in frame.columns if c != out]
    schema = T.StructType([frame.schema[c] for c in carry] + [T.StructField(out, T.StringType())])

    def run(batches):
        code = codec(path, 2)
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            text = code.decode([[i for i in r or [] if i is not None] for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array([None if r is None else t for r, t in zip(rows, text, strict=True)], pa.string())], names=schema.names)

    return bounded(frame).select(*carry).mapInArrow(run, schema)

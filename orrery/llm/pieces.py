"""SentencePiece ids of merge-type (BPE) models by a table over prefixes, and texts back from ids.

Which tokens a merge-type model gives for a prefix of a text does not change when the text goes on
after the last of them, so each prefix has one last token.  It is the one token that ends there and that the
merges leave apart from the last token of the prefix before it.  An automaton names the tokens that
end at each character, a test of pairs finds the one, and the tokens are read backwards from the end.

Two neighbouring characters that no token contains are never merged: texts are parted there
first, and the ids of parts that come again are kept.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mark that stands for a blank, what an unknown id decodes to, and what a byte that is no UTF-8 decodes to.
BLANK, UNKNOWN, NO_TEXT = "▁", " ⁇ ", "�"
#: Parts of a text up to this length are kept with their ids, up to so many in two halves; pairs of tokens likewise, in one.
KEPT_CHARS, KEPT_PARTS, KEPT_PAIRS = 24, 1 << 20, 1 << 20
#: Characters encoded at once.
CHUNK_CHARS = 1 << 20


class KeptParts(dict):
    """The ids of parts of texts, as the bytes of an ``array("i")``; what is not there is found.

    When half of ``KEPT_PARTS`` is full, it becomes the older half and what was that is forgotten,
    so parts that come often stay.
    """

    def __init__(self, find: Callable[[str], list[int]]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = array("i", self.find(part)).tobytes()
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT_PARTS // 2:
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found


class PieceTokenizer:
    """Ids and texts of a merge-type SentencePiece model, given as the bytes of its file.

    Ids equal those of the library's ``encode`` and texts those of its ``decode``, both without
    sampling.  Models that normalise texts, or that are not of merge type, are refused.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as schema

        file = schema.ModelProto()
        file.ParseFromString(model)
        kinds, rules = schema.ModelProto.SentencePiece, file.normalizer_spec
        if file.trainer_spec.model_type != schema.TrainerSpec.BPE:
            raise ValueError("a merge-type model is asked for")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or file.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models that normalise texts are not supported")
        if not file.trainer_spec.byte_fallback or file.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in file.pieces):
            raise ValueError("models without byte tokens, with user-defined or unused tokens or with blanks as suffixes are not supported")
        self.lead = BLANK if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in file.pieces]
        self.score = {p.piece: p.score for p in file.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(file.pieces) if p.type == kinds.NORMAL}
        of_kind = {k: [i for i, p in enumerate(file.pieces) if p.type == k] for k in (kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE)}
        (self.unknown,) = of_kind[kinds.UNKNOWN]
        self.unknown_text = file.trainer_spec.unk_surface
        self.silent = set(of_kind[kinds.CONTROL])
        ends = [i for i in self.silent if self.pieces[i] == file.trainer_spec.eos_piece]
        self.end = ends[0] if ends else None
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in of_kind[kinds.BYTE]}  # written <0x41>
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        self.size = [len(p) for p in self.pieces]
        self.plain = [p.replace(BLANK, " ") for p in self.pieces]  # what an id that is no byte decodes to
        self.plain[self.unknown] = self.unknown_text
        for i in self.silent:
            self.plain[i] = ""
        self.characters = {t for t in self.id if len(t) == 1}
        self.apart: dict[int, bool] = {}  # by first id * number of ids + second id
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id.items():
            *steps, (_, first, last) = self._merges(token)
            if first == last == token:  # other tokens never come out
                self.steps[i] = [*steps, (-math.inf, first, last)]
                self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.is_byte = np.isin(np.arange(len(self.pieces)), list(self.byte_of))
        self.part = self._parts()
        self.known = KeptParts(self._encode_part)

    def _merges(self, text: str) -> Iterator[tuple[float, str, str]]:
        """(score of the next merge, first part, last part) of a short text before each merge and, without a score, after the last.

        Of all neighbours that make a token, the best-scored and then leftmost are joined.
        """
        parts, score = list(text), self.score
        while True:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            yield best, parts[0], parts[-1]
            if at < 0:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _parts(self) -> Callable[[str], list[str]]:
        """Cuts a text where a character that never comes before a blank's mark inside a token meets that mark."""
        joined = {a for t in self.id for a, b in zip(t, t[1:], strict=False) if b == BLANK}
        # Marks that follow a mark, or a character that a token joins to one, stay with it.
        return re.compile(f"(?<=[^{re.escape(''.join(joined | {BLANK}))}])(?={BLANK})").split

    def _stand(self, pair: int) -> bool:
        """Whether the merges leave two tokens apart: no part that ends the left one ever meets a part it is joined to before either is merged on."""
        if len(self.apart) >= KEPT_PAIRS:
            self.apart.clear()
        left, right = (iter(self.steps[i]) for i in divmod(pair, len(self.pieces)))
        (x, _, a), (y, b, _) = next(left), next(right)
        while True:
            across = self.score.get(a + b)
            if across is not None and across > x and across >= y:  # ties go to the left
                found = False
                break
            if x == y == -math.inf:
                found = True
                break
            if x >= y:
                x, _, a = next(left)
            else:
                y, b, _ = next(right)
        self.apart[pair] = found
        return found

    def _encode_known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are tokens."""
        last = [-1] * len(text)  # for each character the last token of the prefix that ends there
        size, many, tested = self.size, len(self.pieces), self.apart.get
        for at, token in self.automaton.iter(text):
            if last[at] < 0:  # there is only one
                before = at - size[token]
                if before >= 0:
                    pair = last[before] * many + token
                    apart = tested(pair)
                    if not (self._stand(pair) if apart is None else apart):
                        continue
                last[at] = token
        at, back = len(text) - 1, []
        while at >= 0:
            token = last[at]
            back.append(token)
            at -= size[token]
        back.reverse()
        return back

    def _encode_part(self, part: str) -> list[int]:
        if self.characters.issuperset(part):
            return self._encode_known(part)
        # Characters without a token merge with nothing: what stands between them is encoded by itself.
        out: list[int] = []
        for known, run in groupby(part, self.characters.__contains__):
            piece = "".join(run)
            if known:
                out += self._encode_known(piece)
            else:
                out += [self.of_byte[b] for b in piece.encode()]
        return out

    def encode(self, text: str) -> array:
        """Ids of a whole text, without marks of begin or end."""
        ids = array("i")
        if text:
            ids.frombytes(b"".join(map(self.known.__getitem__, self.part(self.lead + text.replace(" ", BLANK)))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks of blanks as blanks, but for the leading one that encoding adds; runs of byte tokens as UTF-8."""
        said = next((i for i in ids if i not in self.silent), None)
        if not self.is_byte[np.asarray(ids, np.int32)].any():
            text = "".join(map(self.plain.__getitem__, ids))
        else:
            out, byte_of = [], self.byte_of
            for is_byte, run in groupby(ids, byte_of.__contains__):
                out.append(utf8(bytes(byte_of[i] for i in run)) if is_byte else "".join(map(self.plain.__getitem__, run)))
            text = "".join(out)
        return text[1:] if self.lead and said is not None and said != self.unknown and self.pieces[said].startswith(BLANK) else text


def utf8(data: bytes) -> str:
    """Bytes as UTF-8; of what is none, every byte becomes a replacement character."""
    out = []
    while data:
        try:
            return "".join([*out, data.decode()])
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), NO_TEXT]
            data = data[e.start + 1 :]
    return "".join(out)


@lru_cache(2)
def loaded(model: bytes) -> PieceTokenizer:
    """A worker's tokenizer, with what it has kept from earlier tasks."""
    return PieceTokenizer(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def with_ids(docs: DataFrame, model_path: str | None = None, text: str = "text", end: bool = True) -> DataFrame:
    """Add ``ids`` (array of int) of each whole text, and ``decoded``, the text that the ids give back.

    A null text counts as empty and has the end id only (none without ``end``).  Repeated rows stay
    repeated; other columns pass through, whatever their names; columns with the two names are
    replaced; an empty table stays empty.  The work per character is bounded by the tokens that end there.
    """
    with open(model_path or default_model(), "rb") as f:  # the driver's file; executors get its content
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    shape = T.StructType([base.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(model.value)
        last = array("i", [tokenizer.end] if end else [])

        def block(batch: pa.RecordBatch, start: int, ids: list[array], texts: list[str]) -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids])
            return pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(ids)), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(texts, pa.string())],
                names=["row", "ids", "decoded"],
            )

        for batch in batches:
            ids, texts, start, held = [], [], 0, 0
            for t in batch.column(1):
                ids.append(tokenizer.encode(t.as_py() or "") + last)
                texts.append(tokenizer.decode(ids[-1]))
                held += len(texts[-1])
                if held > CHUNK_CHARS:
                    yield block(batch, start, ids, texts)
                    start, ids, texts, held = start + len(ids), [], [], 0
            if ids:
                yield block(batch, start, ids, texts)

    return base.mapInArrow(encode, shape).select("row.*", "ids", "decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

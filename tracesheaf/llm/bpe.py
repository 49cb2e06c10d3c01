"""BPE encoding by tree concatenation, and decoding.

Short texts are encoded in place. A longer text is cut into pieces that are encoded in parallel as
rows of their own and then concatenated pairwise, level by level. At each join a window around
the cut is encoded again and grows until it agrees with both sides at a point where agreement is
proof: either a non-space character followed by white space (no pre-token crosses it), or a pair of
equal neighbouring tokens inside one run of letters (adjacent pairs decide a BPE encoding).
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import spare_name, text_batches

#: Fixed value: the pre-tokenisation pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 32_768


class Codec:
    """One byte-level BPE vocabulary file, for encoding and decoding."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normalizer or prefix space are supported")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added):
            raise ValueError("added tokens with strip or single_word rules, or with spaces, are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in k): i for k, i in model["vocab"].items() if k not in self.special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("merge order and id order differ")
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = 1 + max([*ranks.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for k, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = k
        self.packed = "<u2" if size <= 1 << 16 else "<u4"
        self.known = np.zeros(size, bool)
        self.known[[*ranks.values(), *self.special.values()]] = True

    def encode(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, allowed_special="all").astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids``; ids outside the vocabulary are skipped, broken UTF-8 becomes U+FFFD."""
        ids = ids[(ids >= 0) & (ids < len(self.known))]
        return self.enc.decode(ids[self.known[ids]].tolist())

    def _starts(self, ids: np.ndarray, data: list[bytes]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(x) for x in data])[:-1]]) if len(ids) else np.zeros(0, int)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Encoding of the text of ``a`` followed by that of ``b``."""
        if not len(a) or not len(b):
            return b if not len(a) else a
        width = 16
        while True:
            i0, j0 = max(0, len(a) - width), min(len(b), width)
            left, right = [self.bytes_of[i] for i in a[i0:]], [self.bytes_of[i] for i in b[:j0]]
            # Both ends of the window must lie between characters.
            while i0 and left and left[0][:1] and 0x80 <= left[0][0] < 0xC0:
                i0 -= 1
                left.insert(0, self.bytes_of[a[i0]])
            while j0 < len(b) and 0x80 <= self.bytes_of[b[j0]][0] < 0xC0:
                right.append(self.bytes_of[b[j0]])
                j0 += 1
            raw, cut = b"".join(left + right), sum(map(len, left))
            new = self.encode(raw.decode("utf-8"))
            starts = self._starts(new, [self.bytes_of[i] for i in new])
            place = {int(s): k for k, s in enumerate(starts)}
            head = (0, 0) if i0 == 0 else self._agree(a[i0:], self._starts(a[i0:], left), new, place, raw, 0, cut)
            tail = (
                (j0, len(new))
                if j0 == len(b)
                else self._agree(b[:j0], cut + self._starts(b[:j0], right), new, place, raw, cut + 1, len(raw))
            )
            if head and tail and head[1] <= tail[1]:
                return np.concatenate([a[: i0 + head[0]], new[head[1] : tail[1]], b[tail[0] :]])
            width *= 4

    def _agree(self, old, at, new, place, raw, low, high) -> tuple[int, int] | None:
        """First (token of ``old``, token of ``new``) from which the two are known to be one encoding."""
        for i, p in enumerate(at.tolist()):
            k = place.get(p)
            if k is None or not low <= p < high:
                continue
            if p and 0x21 <= raw[p - 1] <= 0x7E and raw[p] in b" \n\t\r":
                return i, k
            if i and k and old[i - 1] == new[k - 1] and old[i] == new[k] and at[i - 1] in place and self._letters(raw, p):
                return i, k
        return None

    @staticmethod
    def _letters(raw: bytes, p: int, around: int = 4) -> bool:
        before = raw[max(0, p - 4 * around) : p].decode("utf-8", "ignore")[-around:]
        after = raw[p : p + 4 * around].decode("utf-8", "ignore")[:around]
        return len(before) == len(after) == around and before.isalpha() and after.isalpha()

    def concat(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Encodings of consecutive pieces, joined pairwise level by level."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else np.zeros(0, np.int32)

    def encode_tree(self, text: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
        """What the Spark job computes for one text, for tests."""
        return self.concat([self.encode(text[i : i + piece_chars]) for i in range(0, len(text), piece_chars)])


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: those that print stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(parts: list[np.ndarray], valid: list[bool]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([not v for v in valid]))


def _encoder(path: str):
    @F.arrow_udf("array<int>")
    def encode_texts(texts: pa.Array) -> pa.Array:
        c = codec(path)
        parts, valid = [], []
        for t in texts:
            t = t.as_py()
            parts.append(c.encode(t or ""))
            valid.append(t is not None)
        return _lists(parts, valid)

    return encode_texts


def _packers(path: str):
    """Id lists as bytes for the shuffles of the tree: two bytes an id where the vocabulary allows."""

    @F.arrow_udf("binary")
    def pack(ids: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([v.values.to_numpy(zero_copy_only=False).astype(c.packed).tobytes() for v in ids], pa.binary())

    @F.arrow_udf("array<int>")
    def unpack(data: pa.Array) -> pa.Array:
        c = codec(path)
        return _lists([np.frombuffer(v.as_py(), c.packed).astype(np.int32) for v in data], [True] * len(data))

    return pack, unpack


def _decoder(path: str):
    @F.arrow_udf("string")
    def decode_ids(ids: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(v.values.drop_null().to_numpy(zero_copy_only=False)) if v.is_valid else None for v in ids], pa.string())

    return decode_ids


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``out`` (array<int>; an existing column of that name is replaced).

    Null counts as empty and gives an empty array; repeated rows stay. Texts of more than
    ``piece_chars`` code points go through the tree: distinct long texts are cut, their pieces are
    encoded as separate rows, and one task per long text joins the id lists.
    """
    text_batches(df.sparkSession)
    enc, keep = _encoder(tokenizer), [F.col(f"`{c}`") for c in df.columns if c != out]
    body, key = F.coalesce(F.col(text), F.lit("")), spare_name(df, "text_key")
    joined, n, piece, part = (spare_name(df, x) for x in ("joined", "n", "piece", "part"))
    long = F.length(body) > piece_chars
    short = df.where(~long).select(*keep, enc(body).alias(out))

    pack, unpack = _packers(tokenizer)
    pieces = (
        df.where(long)
        .select(F.sha2(F.col(text), 256).alias(key), F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece_chars}}}"), F.lit(0))).alias(n, piece))
        .dropDuplicates([key, n])
        .select(key, n, pack(enc(piece)).alias(part))
    )

    def assemble(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table[n].to_pylist(), range(table.num_rows)))
        c = codec(tokenizer)
        whole = c.concat([np.frombuffer(table[part][i].as_py(), c.packed).astype(np.int32) for _, i in rows])
        return pa.table({key: table[key][:1].combine_chunks(), joined: pa.array([whole.astype(c.packed).tobytes()], pa.binary())})

    whole = pieces.groupBy(key).applyInArrow(assemble, f"{key} string, {joined} binary")
    longs = df.where(long).select(*keep, F.sha2(F.col(text), 256).alias(key)).join(whole, key)
    return short.unionByName(longs.select(*keep, unpack(joined).alias(out)))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in ``out`` (replaced if there). Null gives null, an empty list an empty text; unknown or null ids are skipped."""
    text_batches(df.sparkSession)
    return df.withColumn(out, _decoder(tokenizer)(F.col(ids)))

"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

A sequence of tokens is the BPE encoding of its string exactly if every token encodes to itself and every two
neighbours are compatible: no merge across their boundary would come before the merges that consume its two sides. So
the encoding of each prefix ends in one definite token, found from the prefixes before it. The merge list bounds how
many symbols behind a token can still change it (``Merges.lookahead``, computed once per file): tokens that lie so far
back are emitted, and their memory released, so a piece of any length takes constant memory. Pieces within the
lookahead end before anything could be emitted; of their end tokens only those on the path are computed.

Pieces (runs of letters, single digits, runs of other signs) and their normal form are those of the tokenizer file.
"""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices, freeing, slices, table, task

#: Results kept for white-space separated chunks and for pieces, per Python worker.
CACHE = 300_000
NEVER = 1 << 60
#: So many last symbols of a string tell how long a token at its end can be (``Merges.reach``).
TAIL = 4


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Merges:
    """The merge list's tables. Tokens are strings here; the last symbol of a piece carries the suffix."""

    def __init__(self, merges: Iterable[tuple[str, str]], vocab: dict[str, int], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for (a, b), i in self.rank.items():
            self.parts.setdefault(a + b, (a, b, i))
        self.good: dict[str, int] = {}
        self._pairs: dict[int, bool] = {}
        self._ends: dict[str, tuple[int, int]] = {}
        self._right: dict[str, list[tuple[str, int]]] = {}
        self._left: dict[str, list[tuple[str, int]]] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self.longest = max(map(self.size, vocab), default=1)
        self.good = {t: i for t, i in vocab.items() if self.whole(t)}
        self.names = {i: t for t, i in self.good.items()}
        self.reach: dict[str, int] = {}
        self.shorter: dict[int, tuple[int, int]] = {}
        for t, i in self.good.items():
            n = self.size(t)
            if n >= TAIL:
                tail = t[n - TAIL :]
                self.reach[tail] = max(n, self.reach.get(tail, TAIL))
            self.shorter[i] = next(((self.good[t[k:]], n - k) for k in range(1, n) if t[k:] in self.good), (-1, 0))
        self.ahead = self.lookahead

    def size(self, token: str) -> int:
        """Symbols of a token."""
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts of a token at one of its ends (0: left, 1: right), outermost first, each with the rank of the merge that consumes it."""
        kept = self._right if side else self._left
        if token not in kept:
            out, t, until = [], token, NEVER
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                a, b, until = self.parts[t]
                t = b if side else a
            kept[token] = out
        return kept[token]

    def _crosses(self, left, right, allowed=None) -> bool:
        for r, r_until in left:
            for x, x_until in right:
                m = self.rank.get((r, x))
                if m is not None and m < r_until and m <= x_until and (r, x) != allowed:
                    return True
        return False

    def fits(self, a: str, b: str) -> bool:
        """Whether b can follow a: no merge across the boundary comes before those that consume its sides."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            known = self._fits[a, b] = not self._crosses(self.spine(a, 1), self.spine(b, 0))
        return known

    def whole(self, token: str) -> bool:
        """Whether a token's own string encodes to it."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.parts:
                known = token in self.vocab
            else:
                a, b, rank = self.parts[token]
                left = [(t, min(u, rank)) for t, u in self.spine(a, 1)]
                right = [(t, min(u, rank)) for t, u in self.spine(b, 0)]
                known = self.whole(a) and self.whole(b) and token in self.vocab and not self._crosses(left, right, (a, b))
            self._whole[token] = known
        return known

    @property
    def lookahead(self) -> int:
        """How many symbols behind a token can still change it, for any text: a bound from the merge list alone.

        Merge i, of u and v, fails only if a part s at the right end of v is consumed from the right first, by a merge
        (s, w) that ranks before the one that consumes s inside v or i itself. That takes the symbols of w, and what
        merge (s, w) itself depends on. Taken in rank order, each merge needs only earlier ones.
        """
        ranks: dict[str, list[int]] = {}
        needs: dict[str, list[int]] = {}
        most = 0
        for (u, v), i in self.rank.items():
            need = 0
            for s, until in self.spine(v, 1):
                if s in ranks and (k := bisect_left(ranks[s], min(until, i))):
                    need = max(need, needs[s][k - 1])
            most = max(most, need)
            ranks.setdefault(u, []).append(i)
            before = needs.setdefault(u, [0])
            if len(before) == len(ranks[u]) and before == [0]:
                before.clear()
            before.append(max(before[-1] if before else 0, self.size(v) + need))
        return most

    def last(self, string: str, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """The last token (id) of the encoding of a string of symbols, and where it starts.

        Short strings are kept for all words, as words share their beginnings; ``known`` keeps the others by length for one word.
        """
        got = known.get(len(string)) or self._ends.get(string)
        if got is not None:
            return got
        to, get, pairs = len(string), self.good.get, self._pairs
        if self.suffix and string.endswith(self.suffix):
            to -= len(self.suffix)
        longest = self.reach.get(string[to - TAIL :], TAIL - 1) if to >= TAIL else to
        at = to - longest if longest < to else 0
        while at < to and (token := get(string[at:])) is None:
            at += 1
        while at < to:
            if at:
                before = self.last(string[:at], known)[0]
                pair = before << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > 400_000:
                        pairs.clear()
                    fits = pairs[pair] = not self._crosses(self.spine(self.names[before], 1), self.spine(self.names[token], 0))
                if not fits:
                    token, size = self.shorter[token]
                    at = to - size
                    continue
            if to < 9 and to == len(string):
                if len(self._ends) >= CACHE:
                    self._ends.clear()
                self._ends[string] = token, at
            else:
                known[len(string)] = token, at
            return token, at
        raise ValueError(f"no token ends {string!r}")

    def short(self, piece: str) -> tuple[int, ...]:
        """The same as stream() for a piece that is at hand whole: of the same end tokens only those on the path are found, backwards from its end."""
        known: dict[int, tuple[int, int]] = {}
        token, at = self.last(piece + self.suffix, known)
        out = [token]
        while at:
            token, at = self.last(piece[:at], known)
            out.append(token)
        return tuple(out[::-1])

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token ids of a stream of symbols (the last with the suffix), each emitted once no future symbol can change it.

        After each symbol, the encoding of what was read ends in one definite token. Tokens of it that end
        ``lookahead`` symbols back or more are stable: they are emitted and what was kept of their symbols is dropped.
        """
        get, pairs, longest = self.good.get, self._pairs, self.longest
        ahead, due = self.ahead, self.ahead + 4 * longest
        window, n, before = "", 0, -1  # symbols since the last emitted token, and that token
        last, begin = [-1], [0]  # by the number of symbols: the last token of the encoding, and where it starts
        for symbol in symbols:
            window += symbol
            n += 1
            for at in range(n - longest if n > longest else 0, n):
                token = get(window[at:])
                if token is None:
                    continue
                left = last[at] if at else before
                if left >= 0:
                    pair = left << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) > 400_000:
                            pairs.clear()
                        fits = pairs[pair] = not self._crosses(self.spine(self.names[left], 1), self.spine(self.names[token], 0))
                    if not fits:
                        continue
                last.append(token)
                begin.append(at)
                break
            else:
                raise ValueError(f"no token for the symbol {symbol!r}")
            if n >= due:
                stable = n
                while stable > n - ahead:
                    stable = begin[stable]
                if stable:
                    yield from self._path(last, begin, stable)
                    before, window, n = last[stable], window[stable:], n - stable
                    last, begin = last[stable:], [x - stable for x in begin[stable:]]
                due = n + 4 * longest
        yield from self._path(last, begin, n)

    @staticmethod
    def _path(last: list[int], begin: list[int], to: int) -> list[int]:
        out = []
        while to:
            out.append(last[to])
            to = begin[to]
        return out[::-1]


class Kept(dict):
    """A function's results for short strings. Those missing are looked for in the generation before, then the function is asked.

    When half of CACHE is reached, this generation becomes the one before, so strings in use stay and rare ones go.
    """

    def __init__(self, of: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.of, self.before = of, {}

    def keep(self, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) < 64:
            if len(self) >= CACHE // 2:
                self.before = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def __missing__(self, key: str) -> tuple[int, ...]:
        return self.keep(key, self.before.get(key) or self.of(key))


class Encoder:
    """Encodes texts like the tokenizer of a file: same normal form, pieces, special tokens and merges."""

    # The normal form and the pieces of the files that can be used; others are refused.
    NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    CUT = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]}
    #: Up to here lower case, composition and the classes of characters are the same in all versions of Unicode.
    PLAIN = re.compile("[^\x00-ɏ]")
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        for part, known in (("normalizer", self.NORMAL), ("pre_tokenizer", self.CUT)):
            if file.get(part) != known:
                raise ValueError(f"{path}: this {part} is not supported")
        if file.get("truncation") or file.get("padding") or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: this model is not supported")
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges((tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]), self.vocab, self.suffix)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.symbols = {i: c for i, c in enumerate(byte_symbols())}
        self.words = Kept(self.chunk)
        self.known = Kept(self.piece)

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk without white space, as byte symbols."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if chunk.isascii() and chunk.isprintable():
            return self.PIECES.findall(chunk.lower())
        if self.PLAIN.search(chunk):
            normal = self.library.normalizer.normalize_str(chunk)
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return [p.encode().decode("latin-1").translate(self.symbols) for p in self.PIECES.findall(chunk.lower())]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece. One that is not longer than the lookahead ends before its first token could be emitted, so its path is read off backwards from its end."""
        whole = self.merges.good.get(piece + self.suffix)
        if whole is not None:
            return (whole,)
        if len(piece) <= self.merges.ahead:
            return self.merges.short(piece)
        return tuple(self.merges.stream(chain(piece[:-1], (piece[-1] + self.suffix,))))

    def piece_kept(self, piece: str) -> tuple[int, ...]:
        """piece() with results kept. An ASCII piece stands for itself as a chunk, so both share a table; other pieces are in byte symbols."""
        if piece.isascii():
            return self.words.get(piece) or self.words.keep(piece, self.words.before.get(piece) or self.piece(piece))
        return self.known[piece]

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk without white space."""
        pieces = self.pieces(chunk)
        if pieces == [chunk] and chunk.isascii():
            return self.piece(chunk)
        return tuple(chain.from_iterable(map(self.piece_kept, pieces)))

    #: str.split() cuts at white space and at these, which are signs here.
    NOT_SPACE = "\x1c\x1d\x1e\x1f"

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in self.NOT_SPACE):
            return re.findall(r"(?:[\x1c-\x1f]|\S)+", text)
        return text.split()

    def encode(self, text: str | None) -> list[int]:
        text, ids, at = text or "", [], 0
        for m in self.specials.finditer(text) if any(t in text for t in self.special) else ():
            ids += self.plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        ids += self.plain(text[at:])
        return ids

    def plain(self, text: str) -> Iterator[int]:
        """Ids of a text without special tokens."""
        return chain.from_iterable(map(self.words.__getitem__, self.chunks(text)))


class Decoder:
    """Turns ids into text, block by block. State: whether anything was written, and the bytes of an unfinished character."""

    def __init__(self, path: str):
        file = json.load(open(path, encoding="utf-8"))
        self.tokens = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.to_bytes = (file.get("decoder") or {}).get("type") == "ByteLevel"
        self.byte = {c: b for b, c in enumerate(byte_symbols())}
        self.reset()

    def reset(self) -> None:
        self.begun, self.rest = False, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        tokens = map(self.tokens.__getitem__, ids)
        if self.to_bytes:
            return self.rest.decode(bytes(self.byte[c] for t in tokens for c in t))
        text = " ".join(tokens)
        if len(ids) and self.begun:
            text = " " + text
        self.begun = self.begun or len(ids) > 0
        return text

    def finish(self) -> str:
        out = self.rest.decode(b"", True)
        self.reset()
        return out

    def decode(self, ids, block: int = 1 << 16) -> str:
        return "".join([*(self.feed(ids[i : i + block]) for i in range(0, len(ids), block)), self.finish()])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def _drop() -> None:
    encoder_of.cache_clear()
    decoder_of.cache_clear()


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the column ``out`` of token ids (array<int>; empty for null or empty texts).

    path: a tokenizer file that each executor has. Every row is encoded for itself, so ties, repeated rows and other
    columns change nothing; a column that is already named ``out`` is replaced; an empty table stays empty.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with task(_drop):
            encoder = encoder_of(path)
            yield from by_slices(batches, lambda texts: [np.array(encoder.encode(t), np.int32) for t in texts], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of their token ids; null ids give an empty text."""

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with task(_drop):
            decoder = decoder_of(path)
            yield from by_slices(batches, lambda rows: [decoder.decode(i or ()) for i in rows], pa.string())

    return docs.withColumn(out, text(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """(doc_id, ids, decoded): encode() and decode() in one pass over a batch, ``rows`` rows at a time, so a task holds few of them.

    One row per row of docs, repeated rows and null ids too; a null text is an empty one and gives no ids. Other
    columns are left out, so none can clash. An empty table gives an empty result.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(path), decoder_of(path)
        for part in slices(batches, rows):
            ids = [np.array(encoder.encode(t), np.int32) for t in part.column(1).to_pylist()]
            texts = pa.array([decoder.decode(i.tolist()) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), texts], names=["doc_id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(freeing(run, _drop), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the documents' texts, for each row as in round_trip()."""
    numbers = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return round_trip(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_transducer(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op4_bpe_transducer": op4_bpe_transducer}

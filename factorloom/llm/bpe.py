"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

BPE has two properties that make streaming exact: the encoding of a prefix ends in one token that does
not depend on what follows, and a row of tokens is an encoding just if each token and each pair of
neighbours is one by itself. So the transducer keeps, for each of the last few positions, the token
that ends the prefix there. Tokens that end at least the merge list's sufficient lookahead before the
newest byte can't change any more, whatever follows; they are emitted and forgotten. Every pre-token
goes through the transducer; normalisation and splitting follow the vocabulary file's own rules.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from factorloom.llm.common import id_and_text, rows_to_batch, text_blocks

#: Cached results of whole words and of neighbour checks; a full cache is emptied, so memory is bounded.
CACHE_WORDS = 1_000_000
#: The same for the library's ids of what stands between spaces, and the longest of these that are kept.
CACHE_PARTS, LONG_PART = 400_000, 64
CACHE_PAIRS = 400_000
#: Bytes of a pre-token that are pushed at once.
CHUNK = 1024
#: Below it no character composes with another, so that each may be judged by itself.
FIRST_COMBINING = 0x300
NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def specification(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def special_and_pattern(spec: dict) -> tuple[dict[str, int], str]:
    """The special tokens' ids, and the expression of pre-tokens."""
    return {t["content"]: t["id"] for t in spec["added_tokens"]}, next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")


class MergeList:
    """Tokens as trees of merges: ranks, spines, and whether two neighbours stay apart."""

    def __init__(self, path: str):
        spec = specification(path)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special, self.pattern = special_and_pattern(spec)
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[str] = [""] * size
        for content, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = content
        self.rank = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = vocab[a], vocab[b]
            made = vocab[a + b]
            self.merged[left, right] = rank
            if self.left[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, left, right
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for content, i in vocab.items():
            at_end = bool(self.suffix) and content.endswith(self.suffix)
            body = bytes(to_byte[c] for c in (content[: -len(self.suffix)] if at_end else content))
            (self.final if at_end else self.inner)[body] = i
        if not self.suffix:
            self.final = self.inner
        self.sizes = [0] * size
        for table in (self.inner, self.final):
            for body, i in table.items():
                self.sizes[i] = len(body)
        self.longest = max(map(len, [*self.inner, *self.final]))
        self._whole: dict[int, bool] = {}
        self._apart: dict[int, bool] = {}
        # A token that isn't the encoding of its own text never occurs.
        self.inner = {b: i for b, i in self.inner.items() if self.whole(i)}
        self.final = {b: i for b, i in self.final.items() if self.whole(i)}
        self.lookahead = self.sufficient_lookahead()

    def spine(self, token: int, side: list[int]) -> list[int]:
        """token and its outermost parts on one side, from the whole down to a byte."""
        out = [token]
        while side[out[-1]] >= 0:
            out.append(side[out[-1]])
        return out

    def apart(self, first: int, second: int) -> bool:
        """Whether no merge ever crosses the boundary between two neighbouring tokens.

        The parts beside the boundary grow along the two spines, in the order of ranks, the left one
        first at equal ranks. A crossing merge happens if it comes before either part grows.
        """
        key = first << 20 | second
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= CACHE_PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._check(first, second)
        return known

    def _check(self, first: int, second: int) -> bool:
        xs, ys = self.spine(first, self.right), self.spine(second, self.left)
        i, j = len(xs) - 1, len(ys) - 1
        while True:
            grow_x = self.rank[xs[i - 1]] if i else NEVER
            grow_y = self.rank[ys[j - 1]] if j else NEVER
            crossing = self.merged.get((xs[i], ys[j]), NEVER)
            if crossing < NEVER and crossing < grow_x and crossing <= grow_y:
                return False
            if not i and not j:
                return True
            if grow_x <= grow_y:
                i -= 1
            else:
                j -= 1

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as this token."""
        known = self._whole.get(token)
        if known is None:
            if self.left[token] < 0:
                known = True
            else:
                a, b = self.left[token], self.right[token]
                known = self.whole(a) and self.whole(b) and self._meets(a, b)
            self._whole[token] = known
        return known

    def _meets(self, first: int, second: int) -> bool:
        """Whether the boundary of a token's two parts is crossed by their own merge and none before."""
        rank = self.merged[first, second]
        xs, ys = self.spine(first, self.right), self.spine(second, self.left)
        i, j = len(xs) - 1, len(ys) - 1
        while i or j:
            grow_x = self.rank[xs[i - 1]] if i else NEVER
            grow_y = self.rank[ys[j - 1]] if j else NEVER
            crossing = self.merged.get((xs[i], ys[j]), NEVER)
            if crossing < grow_x and crossing <= grow_y:
                return False
            if grow_x <= grow_y:
                i -= 1
            else:
                j -= 1
        return self.merged.get((first, second)) == rank

    def extend(self, held: bytes, ends: list[int], before: int, upto: int, at_end: bool) -> None:
        """Append to ends the token that ends the encoding of each held[:i], up to i = upto."""
        for i in range(len(ends), upto + 1):
            ends.append(self.ending(held, ends, before, i, at_end and i == upto))

    def ending(self, held: bytes, ends: list[int], before: int, i: int, at_end: bool) -> int:
        """The one token that ends the encoding of held[:i]; `before` is the token ahead of held, or -1."""
        table, apart = (self.final if at_end else self.inner), self._apart
        for start in range(i - self.longest if i > self.longest else 0, i):
            token = table.get(held[start:i])
            if token is None:
                continue
            left = ends[start] if start else before
            if left < 0:
                return token
            fits = apart.get(left << 20 | token)
            if fits or fits is None and self.apart(left, token):
                return token
        raise ValueError("bytes outside the vocabulary")

    def sufficient_lookahead(self) -> int:
        """Bytes behind a merge that can decide whether it happens.

        A merge (u, v) is decided by v and by earlier-ranked merges that take a right end of v away, and
        those in turn by what decides them: a longest path over ranks.
        """
        reach: dict[int, int] = {}
        best = 1
        for (u, v), _ in sorted(self.merged.items(), key=lambda x: x[1]):
            look = self.sizes[v] + max(reach.get(x, 0) for x in self.spine(v, self.right))
            if look > reach.get(u, 0):
                reach[u] = look
            best = max(best, look)
        return best


class Transducer:
    """Encodes one pre-token from byte chunks; push() and finish() return the ids that have become stable.

    A boundary between tokens is settled by the bytes up to `lookahead` behind it, so no more than that,
    one token and one chunk are held.
    """

    def __init__(self, merges: MergeList):
        self.m = merges
        self.held = b""  # bytes after the last emitted token
        self.ends: list[int] = [0]  # ends[i]: token that ends the encoding of held[:i]; ends[0] unused
        self.before = -1  # the last emitted token

    def push(self, chunk: bytes) -> list[int]:
        """More bytes; the last byte waits, since it may end the pre-token."""
        self.held += chunk
        upto = len(self.held) - 1
        if upto < 1:
            return []
        self.m.extend(self.held, self.ends, self.before, upto, False)
        stable, sizes = upto, self.m.sizes
        while stable > upto - self.m.lookahead and stable:
            stable -= sizes[self.ends[stable]]
        return self._emit(stable)

    def _emit(self, upto: int) -> list[int]:
        out, at = [], upto
        while at > 0:
            out.append(self.ends[at])
            at -= self.m.sizes[self.ends[at]]
        if out:
            self.before = out[0]
            self.held = self.held[upto:]
            self.ends = [0, *self.ends[upto + 1 :]]
        return out[::-1]

    def finish(self) -> list[int]:
        n = len(self.held)
        if not n:
            return []
        self.m.extend(self.held, self.ends, self.before, n - 1, False)
        self.ends.append(self.m.ending(self.held, self.ends, self.before, n, True))
        return self._emit(n)

    def restart(self, shared: int) -> None:
        """Go back to the first `shared` bytes of a pre-token of which nothing was emitted by push()."""
        self.held = self.held[:shared]
        del self.ends[shared + 1 :]

    def whole(self, data: bytes) -> list[int]:
        """The ids of a pre-token that is the held bytes and `data`; the chain of its prefixes is kept for restart()."""
        held = self.held = self.held + data
        n, m = len(held), self.m
        m.extend(held, self.ends, -1, n - 1, False)
        last = m.ending(held, self.ends, -1, n, True)
        ids, at = [last], n - m.sizes[last]
        while at:
            ids.append(self.ends[at])
            at -= m.sizes[self.ends[at]]
        return ids[::-1]


class Encoder:
    """Texts to ids: special tokens, normalisation, pre-tokens, then the transducer for each pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        self.path = path
        self.special, self.pattern = special_and_pattern(specification(path))
        self.characters = byte_characters()
        self.to_byte = {c: b for b, c in enumerate(self.characters)}
        self.piece = regex.compile(self.pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        alike = [c for c in map(chr, range(FIRST_COMBINING)) if self._alike(c)]
        #: A character that the two libraries may class or lower-case otherwise than Python does.
        self.odd = re.compile("[^" + re.escape("".join(alike)) + "]")

    @cached_property
    def merges(self) -> MergeList:
        return MergeList(self.path)

    def _alike(self, c: str) -> bool:
        probe = f"a{c}a{c}1{c}.{c}{c} {c}"
        return self._by_library(probe) == self.piece.findall(probe.lower())

    def _by_library(self, text: str) -> list[str]:
        """Pre-tokens by the vocabulary file's own normaliser and splitter."""
        to_byte = self.to_byte
        return [bytes([to_byte[c] for c in mapped]).decode() for mapped, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pre-tokens in sorted order: a prefix shared with the one before keeps its chain of tokens."""
        machine, known = Transducer(self.merges), self.known
        before = b""
        for piece in sorted(pieces):
            data = piece.encode()
            n = len(data)
            if n > CHUNK:
                known[piece] = _packed(self._stream(data))
                continue
            shared, most = 0, min(len(before), n) - 1
            while shared < most and before[shared] == data[shared]:
                shared += 1
            machine.restart(shared)
            known[piece] = _packed(machine.whole(data[shared:]))
            before = data

    def _stream(self, data: bytes) -> list[int]:
        stream, ids = Transducer(self.merges), []
        for at in range(0, len(data), CHUNK):
            ids += stream.push(data[at : at + CHUNK])
        return ids + stream.finish()

    def _pieces(self, text: str) -> list[str]:
        if self.odd.search(text):
            return self._by_library(text)
        return self.piece.findall(text.lower())

    def _has_special(self, text: str) -> bool:
        return self.specials is not None and "<" in text and self.specials.search(text) is not None

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        parts: list[list[list[str] | bytes]] = []
        for text in texts:
            if not self._has_special(text):
                parts.append([self._pieces(text)])
            else:
                parts.append([_packed([self.special[x]]) if x in self.special else self._pieces(x) for x in self.specials.split(text)])
        seen = {p for row in parts for x in row if isinstance(x, list) for p in x}
        new = seen.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = seen
        self._learn(new)
        ids = self.known.__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(ids, x)) for x in row]) for row in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


class LibraryEncoder(Encoder):
    """The same texts to the same ids, with the tokenizers library's own model for new pre-tokens.

    Under a pattern that neither holds nor looks over white space, the texts of a block are parted at spaces by Arrow, and
    each distinct part is looked up once in a block; its pre-tokens are sought only when it is new.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.parts, self.earlier = {}, {}

    def _learn(self, pieces: set[str]) -> None:
        for piece in pieces:
            self.known[piece] = self._ids(piece)

    def _ids(self, piece: str) -> bytes:
        characters = self.characters
        mapped = piece if piece.isascii() and piece.isprintable() else "".join([characters[b] for b in piece.encode()])
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _part(self, part: str) -> bytes:
        """The ids of a lower-case text without spaces. Full caches are put by, and what is asked for again comes back."""
        found = self.earlier.get(part)
        if found is None:
            pieces = [part] if part.isascii() and part.isalpha() else self.piece.findall(part)
            found = self._ids(pieces[0]) if len(pieces) == 1 else b"".join([self.parts.get(x) or self._part(x) for x in pieces])
        if len(part) <= LONG_PART:
            if len(self.parts) >= CACHE_PARTS // 2:
                self.earlier, self.parts = self.parts, {}
            self.parts[part] = found
        return found

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(_marks_apart(pa.array([x.lower() for x in texts], pa.large_string())))
        coded = split.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids = [self.parts.get(x) or self._part(x) for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = flat[np.repeat(starts[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [out[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        plain = [self.pattern in BETWEEN_SPACE and not self.odd.search(x) and not self._has_special(x) for x in texts]
        found = iter(self._by_parts([x for x, p in zip(texts, plain, strict=True) if p]))
        others = iter(super().encode_many([x for x, p in zip(texts, plain, strict=True) if not p]))
        if len(self.known) > CACHE_PARTS // 2:
            self.known.clear()
        return [next(found if p else others) for p in plain]

    def rest(self) -> None:
        """Give memory back between tasks: a worker that waits holds half a cache at most."""
        self.earlier = {}
        self.known.clear()


#: Patterns whose pre-tokens hold no white space and do not depend on any.
BETWEEN_SPACE = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _marks_apart(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """A space before each comma and full stop that is a pre-token by itself, between a letter and white space; so there are fewer distinct parts."""
    _, offsets, data = texts.buffers()
    body, bounds = np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)
    at = 1 + np.flatnonzero((body[1:-1] == ord(",")) | (body[1:-1] == ord(".")))
    at = at[(body[at - 1] >= ord("a")) & (body[at - 1] <= ord("z")) & ((body[at + 1] == ord(" ")) | (body[at + 1] == ord("\n")))]
    if not len(at):
        return texts
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds + np.searchsorted(at, bounds)), pa.py_buffer(np.insert(body, at, ord(" "))))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Decoder:
    """Ids to text in pieces, with constant memory.

    joined: what a tokenizer without a decoder gives, the tokens' strings with single spaces between.
    Otherwise bytes: each token's characters are turned into bytes and UTF-8 is decoded as it becomes
    whole; a word's end gives a space.
    """

    def __init__(self, merges: MergeList, joined: bool = True):
        self.strings, self.joined, self.suffix = merges.strings, joined, merges.suffix
        self.started = False
        self.pending = ""
        if not joined:
            self.to_byte = {c: b for b, c in enumerate(byte_characters())}
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        strings = self.strings
        if self.joined:
            out = " ".join([strings[i] for i in ids])
            if out and self.started:
                out = " " + out
            self.started |= bool(out)
            return out
        out = []
        for i in ids:
            content = strings[i]
            at_end = bool(self.suffix) and content.endswith(self.suffix)
            body = content[: -len(self.suffix)] if at_end else content
            out.append(self.utf8.decode(bytes(self.to_byte[c] for c in body)) if all(c in self.to_byte for c in body) else body)
            if at_end:
                out.append(" ")
        return "".join(out)

    def finish(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    return Encoder(path)


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def decode_pieces(merges: MergeList, ids: bytes, block: int = 65536) -> Iterator[str]:
    """The text of the ids in pieces of `block` ids."""
    values, machine = np.frombuffer(ids, "<u4"), Decoder(merges)
    for at in range(0, len(values), block):
        yield machine.push(values[at : at + block].tolist())
    yield machine.finish()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row.

    Null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows; a null doc_id stays null; an
    empty table gives no rows; extra columns are ignored; texts of any length are encoded whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        for doc_ids, texts in text_blocks(batches):
            rows = []
            for doc_id, ids in zip(doc_ids, machine.encode_many(texts), strict=True):
                decoded = hashlib.sha256()
                for piece in decode_pieces(machine.merges, ids):
                    decoded.update(piece.encode())
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            yield rows_to_batch(rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row: ids is an array of int."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in text_blocks(batches):
            yield rows_to_batch([(d, np.frombuffer(i, "<u4").tolist()) for d, i in zip(doc_ids, encoder(path).encode_many(texts), strict=True)], schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")

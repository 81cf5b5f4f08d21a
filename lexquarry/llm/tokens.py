"""Token ids of whole texts by the tokenizers library, with the ids of chunks kept per Python worker."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import cached, cpu_bound_python

#: Between two characters that are not white space, a single space or newline is always a boundary of the byte-level pattern: the
#: space goes to the chunk after it, the newline is a token of its own. Texts with longer runs are cut by ODD_CHUNK instead.
RUN = re.compile(r"\s\s").search
#: White space to Python's patterns, but not to the tokenizer's: such texts are encoded in one piece.
ODD = re.compile(r"[\x1c-\x1f]").search
ODD_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s").findall
#: Letters, then ASCII marks: each part is one word of the pattern, so the model alone gives its ids. (A contraction has letters last.)
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ſ]*)([!-/:-@\[-`{-~]*)").fullmatch
#: Pairs of the commonest white space are found faster without a pattern; texts with no other white space need no more.
PAIRS = ("  ", "\n\n", " \n", "\n ")
OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
#: Texts with such white space are not cut by their bytes.
SPACED = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]"
#: What PLAIN has, cut from the space on: one word of the pattern.
ONE_WORD = r"^ ?(?:[A-Za-zÀ-ÖØ-öø-ſ]+|[!-/:-@\[-`{-~]+)$"
LETTER, MARK, LATIN, NEXT = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
_KIND[0xC3:0xC6], _KIND[0x80:0xC0] = LATIN, NEXT
#: Entries kept; one is about 200 bytes.
KEPT = 1_500_000
#: Bytes of text that are cut together, and new words that the library gets in one call.
PORTION = 8 << 20
CALL = 20_000


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell every byte as a printable letter: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks(dict):
    """Ids of chunks kept; a new one is encoded as it is met, so that a text is gone through once."""

    def __init__(self, made: Callable[[str], bytes]):
        super().__init__()
        self.made = made

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.made(chunk)
        return ids


class Numbers(dict):
    """What texts were cut into, kept for whole batches: the number of each piece, and the ids of all, by number."""

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int32)

    def learn(self, pieces: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.update(zip(pieces, range(len(self), len(self) + len(pieces)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int32)])
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    """Exactly Tokenizer.encode(text, add_special_tokens=False).ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        cpu_bound_python()
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.otherwise = "|".join([SPACED, *map(re.escape, self.added)])
        self.kept = Chunks(self._chunk)
        self.marks: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.ids = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.line = self._slow("\n")
        self.numbers = Numbers()
        #: The model alone, given spelled words in lines, without offsets; and how many bytes each id stands for.
        self.words = Tokenizer(self.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.spelled = [(chr(b), self.letters[b]) for b in (ord(" "), *range(128, 256)) if chr(b) != self.letters[b]]
        self.bytes = np.array([len(self.whole.id_to_token(i) or "") for i in range(len(self.ids))], np.int64)

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """One word of the pattern, spelled for the model."""
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(piece)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that follows a space, or of one that begins with a newline or (marked by NUL) a text."""
        if chunk.isascii() and chunk.isalpha():
            return self._piece("Ġ" + chunk)
        lead = chunk[:1]
        m = PLAIN(chunk, 1 if lead in ("\n", "\0") else 0)
        if m is None:
            return self._slow(chunk[1:] if lead == "\0" else chunk if lead == "\n" else " " + chunk)
        word, marks = m.groups()
        space = "" if lead in ("\n", "\0") else "Ġ"
        head = self.line if lead == "\n" else b""
        if word:
            known = self.kept.get(word) if space and marks else None
            if known is None:
                known = self._piece(space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))
            head, space = head + known, ""
        elif not marks:
            return head + (self._piece(space) if space else b"")
        if marks:
            tail = self.marks.get(space + marks)
            if tail is None:
                tail = self._piece(space + marks)
                if len(self.marks) < 10_000:
                    self.marks[space + marks] = tail
            return head + tail
        return head

    def encode(self, text: str) -> bytes:
        # The library cuts at added tokens first, so white space before one ends a text there.
        other = OTHER(text)
        if other and ODD(text) or "\0" in text or any(t in text for t in self.added):
            return self._slow(text)
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        if any(p in text for p in PAIRS) or other and RUN(text):
            return b"".join(map(self._slow, ODD_CHUNK(text)))
        chunks = ("\0" + text.replace("\n", " \n")).split(" ")
        return b"".join(itemgetter(*chunks)(kept)) if len(chunks) > 1 else kept[chunks[0]]

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words of the pattern, one after another, and how many each has. They go to the model together, in lines; as
        ids stand for whole bytes of one line, a word's end where its bytes do."""
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        lines = lines.encode().decode("latin-1")
        for byte, letter in self.spelled if not lines.isascii() else self.spelled[:1]:
            lines = lines.replace(byte, letter)
        ids = np.array(self.words.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
        at, wanted = np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
        ends = np.searchsorted(at, wanted) + 1
        if len(at) == 0 or at[-1] != wanted[-1] or (at[ends - 1] != wanted).any():  # a vocabulary without some byte
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _each(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._slow(w) for w in words.to_pylist()]
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids])

    def _portion(self, texts: pa.StringArray) -> pa.ListArray:
        """As encode_all, of texts without SPACED and added tokens. They are cut before and after a newline, before a space, and
        between a letter and a mark: the pattern has a boundary there, and what stands before it does not matter after it."""
        if not len(texts):
            return pa.array([], pa.list_(pa.uint32()))
        numbers = self.numbers
        if len(numbers) > KEPT or len(numbers.ids) > 16 * KEPT:
            numbers.clear()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind, cut = _KIND[data], (data == 32) | (data == 10)
        cut[1:] |= data[:-1] == 10
        marks = np.flatnonzero((kind[1:] == MARK) & (kind[:-1] != MARK)) + 1
        before = np.where(marks > 1, data[marks - 2], 0)
        latin = (kind[marks - 1] == NEXT) & (_KIND[before] == LATIN) & ((before != 0xC3) | (data[marks - 1] & 0xDF != 0x97))  # no × or ÷
        cut[marks[(kind[marks - 1] == LETTER) | latin]] = True
        cut[offsets[offsets < len(data)]] = True
        starts = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        words = coded.dictionary
        code = np.fromiter(map(numbers.get, words.to_numpy(zero_copy_only=False), repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(code < 0)
        plain = pc.match_substring_regex(words.take(pa.array(new)), ONE_WORD).to_numpy(zero_copy_only=False)
        for which, ids_of in ((new[plain], self._words), (new[~plain], self._each)):
            for i in range(0, len(which), CALL):
                some = which[i : i + CALL]
                code[some] = np.arange(len(numbers), len(numbers) + len(some))
                found = words.take(pa.array(some))
                numbers.learn(found.to_numpy(zero_copy_only=False), *ids_of(found))
        known = pa.ListArray.from_arrays(pa.array(numbers.ends), pa.array(numbers.ids))
        ids = known.take(pa.array(code)).take(coded.indices)
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[np.searchsorted(starts, offsets)]), ids.values)

    def encode_all(self, texts: pa.StringArray) -> Iterator[pa.ListArray]:
        """The ids of each text as encode gives them, in portions of texts. A piece is looked up once a portion, and new ones go
        to the library many at a time."""
        if not len(texts):
            return
        texts = texts.cast(pa.string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(sizes // PORTION)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = texts.slice(a, b - a)
            whole = pc.match_substring_regex(part, self.otherwise)
            if not pc.any(whole).as_py():
                yield self._portion(part)
                continue
            odd = [np.frombuffer(self.encode(x), "<u4") for x in part.filter(whole).to_pylist()]
            both = pa.concat_arrays([self._portion(part.filter(pc.invert(whole))), pa.array(odd, pa.list_(pa.uint32()))])
            yield both.take(pa.array(np.argsort(np.argsort(whole.to_numpy(zero_copy_only=False), kind="stable"))))


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    own = Encoder(path)
    cached("chunks", own.kept)
    cached("numbers", own.numbers)
    return own

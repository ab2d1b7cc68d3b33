"""Token ids of whole texts with a public tokenizer: distinct pieces are encoded once, their words remembered."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.compute as pc

#: White space of Unicode but the space and the line end, as a class of the columnar library's patterns.
_WHITE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What begins a text's first piece, which no space comes before.
_FIRST = "\x00"
#: Bytes of texts whose pieces are made distinct together, and bytes whose ids are put together at once.
GROUP_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
#: Pieces that are encoded as one text; words that are remembered.
_JOINED, _WORDS = 2_000, 200_000
#: Plain pieces are a word and marks, and perhaps a line end and as much again: both tokenizers split them into these parts.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?"
_PLAIN = rf"^(?P<first>{_FIRST}?)(?P<word>[{_LETTERS}]+)(?P<marks>[{_MARKS}]*)(?:(?P<end>\n)(?P<next>[{_LETTERS}]+)(?P<more>[{_MARKS}]*))?$"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: printable ones stand for themselves, others follow at 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _runs(pool, start, size):
    """The runs of a pool one after the other."""
    import numpy as np

    before = np.cumsum(size) - size
    return pool[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, exactly as the tokenizer does for the whole text.

    Two kinds of tokenizers are known, others are an error: byte-level BPE whose pattern keeps a space with the word
    behind it, and BPE with word ends whose pattern drops white space. Neither has a pattern that matches across the
    place before a space that follows a character other than white space, so a text is the sequence of its pieces cut
    there, each encoded alone. The distinct pieces of some megabytes of texts are encoded once, then each text's ids are
    gathered. Plain pieces are looked up by word; words that are not remembered go through the tokenizer's model, and at
    most _WORDS are, a full memory is emptied. Other pieces are encoded together, joined by a mark that is always a token
    of its own; pieces in which the mark could join its neighbours are encoded alone, and texts with white space before
    a space as a whole where the tokenizer keeps white space. The strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        keeps_space = made["normalizer"] is None and made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        drops_space = made["model"]["end_of_word_suffix"] == "</w>" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "[^\\s" in steps[0]["pattern"].get("Regex", "")
        if made["model"]["type"] != "BPE" or not (keeps_space or drops_space):
            raise ValueError(f"{path}: neither byte-level BPE that keeps spaces nor BPE with word ends")
        if keeps_space:
            self.mark, self.whole, self.alone = "\r", rf"[\n {_WHITE}] |{_FIRST}.*{_FIRST}", rf"[{_WHITE}]|\n\n|\n$|^{_FIRST}?\n|^{_FIRST}?$"
        else:
            self.mark, self.whole, self.alone = " \x01 ", rf"{_FIRST}.*{_FIRST}", rf"[\x01{_WHITE}]|^{_FIRST}?$"
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.model, self.letters, self.keeps_space = self.tokenizer.model, _byte_letters(), keeps_space
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.known, self.ids, self.start, self.size = {}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, words: list[str]):
        """The words' numbers among the remembered ones; those that are new are encoded."""
        import numpy as np

        if len(self.known) > _WORDS:
            self._forget()
        known, model, letters = self.known, self.model, self.letters
        new = [w for w in words if w not in known]
        if new:
            found = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))] if w else [] for w in new]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(size) - size]
            self.size = np.r_[self.size, size]
            self.ids = np.r_[self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _plain(self, parts: pa.StructArray):
        """The ids of plain pieces one after the other, and how many each has."""
        import numpy as np

        first, word, marks, end, after, more = parts.flatten()
        if self.keeps_space:
            word = pc.if_else(pc.equal(first, ""), pc.binary_join_element_wise(pa.scalar(" ", word.type), word, pa.scalar("", word.type)), word)
        else:
            word, after, end = pc.utf8_lower(word), pc.utf8_lower(after), pc.replace_substring(end, "\n", "")
        slots = pa.concat_arrays([pc.fill_null(x, "") for x in (word, marks, end, after, more)]).dictionary_encode()
        at = self._numbers(slots.dictionary.to_pylist())[slots.indices.to_numpy()].reshape(5, -1).T.ravel()
        size = self.size[at]
        return _runs(self.ids, self.start[at], size), size.reshape(-1, 5).sum(axis=1)

    def _whole(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null is the empty text."""
        import numpy as np

        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out: list[bytes] = []
        while len(out) < len(texts):
            base = ends[len(out) - 1] if out else 0
            stop = max(len(out) + 1, int(np.searchsorted(ends, base + GROUP_BYTES, side="right")))
            out += self._group(texts.slice(len(out), stop - len(out)))
        return out

    def _group(self, texts: pa.Array) -> list[bytes]:
        import numpy as np

        marked = pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), texts, pa.scalar("", pa.large_string()))
        whole = pc.match_substring_regex(marked, f"(?s){self.whole}").to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        odd = np.flatnonzero(whole).tolist()
        for i in odd:  # one by one: they may be long
            out[i] = self._whole([texts[i].as_py()])[0].tobytes()
        cut = pc.split_pattern(marked.filter(pa.array(~whole)), " ")
        pieces = pc.list_flatten(cut).dictionary_encode()
        pool, start, size = self._pieces(pieces.dictionary)
        index = pieces.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        rows = np.flatnonzero(~whole)
        at = 0
        while at < len(rows):
            first = int(ends[at - 1]) if at else 0
            total = np.cumsum(size[index[first : first + (SLICE_BYTES >> 2)]])
            stop = max(at + 1, int(np.searchsorted(ends, first + len(total), side="right")))
            own = index[first : int(ends[stop - 1])]
            ids = _runs(pool, start[own], size[own])
            cuts = np.r_[0, np.cumsum(size[own])][np.r_[0, ends[at:stop] - first]].tolist()
            for row, a, b in zip(rows[at:stop].tolist(), cuts, cuts[1:]):
                out[row] = ids[a:b].tobytes()
            at = stop
        return out

    def _pieces(self, pieces: pa.Array):
        """The ids of some pieces one after the other, and where each piece's begin and how many they are."""
        import numpy as np

        parts = pc.extract_regex(pieces, _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        start, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        pool, size[plain] = self._plain(parts.filter(pa.array(plain)))
        pools, at = [pool], len(pool)
        start[plain] = np.cumsum(size[plain]) - size[plain]
        # The others, together where that is safe.
        rest = np.flatnonzero(~plain)
        others = pieces.take(pa.array(rest))
        alone = pc.match_substring_regex(others, self.alone).to_numpy(zero_copy_only=False)
        full = [p[1:] if p[:1] == _FIRST else " " + p for p in others.to_pylist()]
        together, single = np.flatnonzero(~alone).tolist(), np.flatnonzero(alone).tolist()
        joined = [self.mark.join([full[i] for i in together[k : k + _JOINED]]) + self.mark for k in range(0, len(together), _JOINED)]
        pool = np.concatenate([np.zeros(0, np.uint32), *self._whole(joined)])
        marks = np.flatnonzero(pool == self.mark_id)
        if len(marks) != len(together):
            raise ValueError("a piece holds the mark between pieces")
        first = np.r_[0, marks[:-1] + 1] if len(marks) else np.zeros(0, np.int64)
        start[rest[together]], size[rest[together]] = at + first, marks - first
        found = self._whole([full[i] for i in single])
        n = np.fromiter(map(len, found), np.int64, len(found))
        start[rest[single]], size[rest[single]] = at + len(pool) + np.cumsum(n) - n, n
        return np.concatenate([*pools, pool, *found]), start, size


_OPEN: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The encoder of this Python worker, read from its file once."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Encoder(path)
    return _OPEN[path]

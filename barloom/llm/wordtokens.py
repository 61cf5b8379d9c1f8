"""Token ids with a public vocabulary that splits at white space, word by word.

The vocabulary's pattern never matches across white space, and its normaliser changes each character by itself or with
the marks that follow it, so the ids of a text are those of its runs between ASCII white space, one after the other.
Frequent runs are kept per worker, up to a bound, as the bytes of their ids.

Runs of ASCII, Western letters and common quotes and dashes only are split here, by the vocabulary's pattern within
that alphabet, where the normaliser does no more than lower-case, and merged by another library, with the vocabulary's
ids as merge ranks.  That library merges whatever two neighbours make a known token, and not named pairs only; this is the
same as long as every token comes out whole when it is encoded by itself, so tokens that don't are left out of its
ranks (no text can have them).  All other runs, and those that may hold a special token, go through the tokenizer.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Runs that a worker keeps; few enough to stay near the processor.
KEPT_RUNS = 50_000
#: Stands for the end of a word where the vocabulary has a suffix.  No run that is merged here holds it.
END = b"\x01"

#: What the short way doesn't cover: anything but this alphabet, and the start of a special token.
ODD = re.compile(r"[^\n\x21-\x7eÀ-ÖØ-öø-ÿ¡«»¿‐-‧]|<\|")
#: Fixed value: the vocabulary's pattern, lower-cased and within that alphabet; a line end parts two runs.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+|\n")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next above 255."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(256, 512))
    return [chr(b if b in prints else next(later)) for b in range(256)]


class Words:
    """Encodes texts, and remembers their runs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        letters = _byte_letters()
        model, byte_of = self.whole.model, {c: b for b, c in enumerate(letters)}
        apart = model.tokenize(letters[0])[0].id  # no merge knows this letter, so a word part before it stays by itself
        ranks = {}
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>")
            alone, want = (body + letters[0], [i, apart]) if body == token else (body, [i])
            if [t.id for t in model.tokenize(alone)] == want:
                ranks[bytes(byte_of[c] for c in body) + (b"" if body == token else END)] = i
        self.merger = tiktoken.Encoding(path, pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n" + END]
        self.kept: dict[bytes, bytes] = {}

    def slow(self, run: bytes) -> bytes:
        return np.asarray(self.whole.encode(run.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, runs: list[bytes]) -> dict[bytes, bytes]:
        joined, out = b"\n".join(runs).decode("utf-8"), {}
        if ODD.search(joined):
            odd = [r for r in runs if ODD.search(r.decode("utf-8"))]
            out = {r: self.slow(r) for r in odd}
            runs = [r for r in runs if r not in out]
            joined = b"\n".join(runs).decode("utf-8")
        if runs:
            ids = np.asarray(self.merger.encode_ordinary("\x01".join(PIECE.findall(joined.lower())) + "\x01"), "<u4")
            at = np.flatnonzero(ids == self.line_end)
            raw = ids.tobytes()
            out |= zip(runs, [raw[4 * a : 4 * b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)], strict=True)
        return out

    def text(self, text: bytes | None) -> bytes:
        runs = text.split() if text else []  # of bytes: at ASCII white space only
        new = list(set(runs).difference(self.kept))
        if not new:
            return b"".join(map(self.kept.__getitem__, runs))
        here = self.encode(new)
        if len(self.kept) + len(here) > KEPT_RUNS:
            self.kept = {}
            here |= self.encode(list(set(runs).difference(here)))
        self.kept.update(here)
        return b"".join(map(self.kept.__getitem__, runs))


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def ids_bytes(texts: list[bytes | None], path: str) -> list[bytes]:
    """Each UTF-8 text's ids as little-endian unsigned 32-bit numbers (null: none)."""
    return list(map(words(path).text, texts))

"""Token ids of whole texts by a public tokenizer, with a memo of the ids of text pieces.

A text is cut only where the tokenizer's own pre-tokens end whatever stands around: before a single space or line feed
between two non-space characters, and before a full stop or comma behind a letter or digit. So the ids of the pieces,
one after the other, are the ids of the text. Null texts count as empty and have no ids.

A literal that the tokenizer adds to its vocabulary, as <|endoftext|>, is its one id wherever it stands in a text, as the
tokenizer gives it by itself; texts that hold one, in whatever case, are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Tokenizer files by name; the folder is a parameter of the library that owns them.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces that one generation of the memo holds, unless a caller says otherwise; two generations are kept, so memory is bounded.
MEMO = 300_000

_GAP = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[A-Za-z0-9À-ÖØ-öø-ɏ])(?=[.,])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_MARK, _CUT_MARK = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ɏ][.,]"), re.compile(r"[ \n]|(?<=[A-Za-z0-9À-ÖØ-öø-ɏ])(?=[.,])")


def _odd(text: str) -> bool:
    """Whether a full stop or comma stands behind anything but a letter or digit, or zeros are in the text (one search a pattern: alternatives are slower)."""
    return "\0" in text or text[:1] in (".", ",") or _MARK.search(text) is not None


def pieces(text: str, folds: bool = False) -> list[str]:
    """folds: for tokenizers that lower-case and drop white space, A-Z is lower-cased and spaces and line feeds are left out."""
    if folds:
        text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        if _odd(text):
            return _CUT_MARK.split(text)
        return text.replace(" ", "\0").replace("\n", "\0").replace(".", "\0.").replace(",", "\0,").split("\0")
    if text[:1].isspace() or text[-1:].isspace() or _GAP.search(text) or _odd(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").replace(".", "\0.").replace(",", "\0,").split("\0")


class Encoder:
    """encode(texts) gives each text's ids; separator is a string that the tokenizer always makes one id of its own of."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.literals = [t.content.lower() for t in self.inner.get_added_tokens_decoder().values()]
        self.literal_start = re.match("[^a-z]*", os.path.commonprefix(self.literals))[0]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo = memo
        self.folds = self._plain("A\nb c") == self._plain("a") + self._plain("b") + self._plain("c")
        self.between, self.mark = next((s, self._plain(s)[0]) for s in ("\n", " | ") if len(self._plain(s)) == 1)

    def _plain(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def _literal(self, text: str) -> bool:
        """Whether a literal is in the text or would be once lower-cased; what starts all of them is looked for first."""
        return bool(self.literals) and self.literal_start in text and any(x in text.lower() for x in self.literals)

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces that neither generation knows: many of them in one call, told apart by the mark."""
        inside = self.between.strip() or self.between
        joined = [p for p in new if inside not in p and p and not p[-1].isspace()]
        parts = [joined[k : k + 16] for k in range(0, len(joined), 16)]
        got = self.inner.encode_batch_fast([self.between.join(x) for x in parts], add_special_tokens=False)
        for part, encoded in zip(parts, got, strict=True):
            ids = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(part) - 1:
                raw, begin = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
                self.young.update(zip(part, map(raw.__getitem__, map(slice, begin, [*(4 * ends).tolist(), len(raw)])), strict=True))
            else:
                self.young.update((p, np.array(self._plain(p), np.uint32).tobytes()) for p in part)
        for p in set(new).difference(joined):
            self.young[p] = np.array(self._plain(p), np.uint32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), 64):
            whole = {i: np.array(self._plain(t), np.uint32) for i, t in enumerate(texts[k : k + 64]) if t and self._literal(t)}
            cut = [pieces(t, self.folds) if t and i not in whole else [] for i, t in enumerate(texts[k : k + 64])]
            if len(self.young) > self.memo:
                self.young, self.old = {}, self.young
            young, old = self.young, self.old
            found = [list(map(young.get, c)) for c in cut]
            gaps = [(c, f, [k for k, ids in enumerate(f) if ids is None]) for c, f in zip(cut, found, strict=True) if None in f]
            new = []
            for p in {c[k] for c, _, at in gaps for k in at}:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
            self._learn(new)
            for c, f, at in gaps:
                for k in at:
                    f[k] = young[c[k]]
            out += [whole[i] if i in whole else np.frombuffer(b"".join(f), np.uint32) for i, f in enumerate(found)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder a file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, memo)
    return _ENCODERS[path]

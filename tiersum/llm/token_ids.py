"""Token ids of whole texts by the tokenizers library, with the words that recur kept by each worker."""

from __future__ import annotations

import os

import numpy as np

from tiersum.llm.common import LONG_WORD, per_worker

#: Stands between words that are encoded together; it's a word of its own in the vocabulary's split pattern.
MARK = "\x01"
#: White space for Python but not for the library.
CONTROLS = "\x1c\x1d\x1e\x1f"
ENDS = ",.;:!?"


def one_word(run: str) -> bool:
    """Whether a run is one word of the split pattern for sure: Latin letters only, also after normalization."""
    return run.isalpha() and (run.isascii() or (max(run) < "\u0250" and "\u0130" not in run))


def _nones(values: list) -> list[int]:
    """Positions of None."""
    out, at = [], -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        out.append(at)
    return out


class IdEncoder:
    """encode(text): ids as little-endian unsigned 32-bit integers.

    No token crosses white space, so that a text's ids are those of its runs without white space. Runs not seen
    lately are encoded by the library, many in one call. Texts with special tokens or odd control characters go to it whole.
    """

    def __init__(self, path: str, cache_size: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = [*CONTROLS, MARK, *self.special]
        (self.mark,) = self.whole(MARK)
        self.ends = {c: self.whole(c).tobytes() for c in ENDS}
        self.size, self.young, self.old = cache_size, {}, {}
        vocabulary = self.library.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.largest = self.library.get_vocab_size(with_added_tokens=True) - 1

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, runs: set[str]) -> None:
        """Ids of all runs into the young generation."""
        if len(self.young) + len(runs) > self.size:
            self.old, self.young = self.young, {}
        young, old, ends = self.young, self.old, self.ends
        bare: dict[str, str] = {}
        for r in runs:
            got = old.get(r)
            if got is not None:
                young[r] = got
            else:
                w = r[:-1] if r[-1] in ends and one_word(r[:-1]) else r
                bare[r] = w.lower() if w.isascii() else w
        letters, other = [], []
        for w in {*bare.values()}:
            if w not in young:
                got = old.get(w)
                if got is not None:
                    young[w] = got
                elif one_word(w):
                    letters.append(w)
                else:
                    other.append(w)
        for words, between in ((letters, " "), (other, f" {MARK} ")):
            for lo in range(0, len(words), 2000):
                part = words[lo : lo + 2000]
                ids = self.whole(between.join(part))
                if words is letters:
                    stops = np.nonzero(self.final[ids])[0] + 1
                    starts = np.concatenate(([0], stops[:-1]))
                else:
                    marks = np.nonzero(ids == self.mark)[0]
                    starts, stops = np.concatenate(([0], marks + 1)), np.concatenate((marks, [len(ids)]))
                data = ids.tobytes()
                for w, i, j in zip(part, (4 * starts).tolist(), (4 * stops).tolist()):
                    young[w] = data[i:j]
        for r, w in bare.items():
            if r != w:
                young[r] = young[w] + ends[r[-1]] if len(r) > len(w) else young[w]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; runs new to this worker go to the library together."""
        split = [[] if not t or any(map(t.__contains__, self.odd)) else t.split() for t in texts]
        found = [list(map(self.young.get, runs)) for runs in split]
        holes = [(runs, got, at) for runs, got in zip(split, found) if (at := _nones(got))]
        if holes:
            self._learn({runs[i] for runs, _, at in holes for i in at})
            young = self.young
            for runs, got, at in holes:
                for i in at:
                    got[i] = young[runs[i]]
            for r in [r for runs, _, at in holes for i in at if len(r := runs[i]) > LONG_WORD]:
                for kept in (r, r.lower(), r[:-1], r[:-1].lower()):
                    young.pop(kept, None)
        return [b"".join(got) if got else self.whole(t).tobytes() if t else b"" for t, got in zip(texts, found)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def id_encoder(path: str, cache_size: int = 600_000) -> IdEncoder:
    return per_worker(("token ids", path, cache_size), lambda: IdEncoder(path, cache_size))

"""Encoding with public tokenizers, word by word.

A BPE tokenizer first splits a text into pre-tokens and encodes each alone. Where a text can be cut without cutting a
pre-token, its pieces are encoded once and kept in a bounded table; what repeats is only looked up, and that once for each
different piece of a block of texts: Arrow numbers a block's pieces, and NumPy gathers the ids. The ids are those of the
whole text (tests compare them).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many pieces are kept, and as many of those before them; then the oldest go. Bounds memory, not results.
KEPT = 450_000
#: Pieces encoded in one call, documents whose pieces are gathered for it and about the most characters of these (or one document),
#: and pieces whose ids are gathered at once.
CALL, GATHER, CHARACTERS, AT_ONCE = 400, 512, 1 << 21, 1 << 20
_ENCODERS: dict[str, Encoder] = {}
#: Letters that every version of Unicode has, with the space that may lead them: one pre-token.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Letters and the marks after them: two pre-tokens.
_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENDED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")


class Encoder:
    """encoded(texts) of a tokenizers file, without special tokens; a special token's string in a text is ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        rules = json.loads(self.whole.to_str())
        self.added = [x["content"] for x in rules["added_tokens"]]
        self.how = self._how(rules)
        # A cut before a space or around a line break is safe where no other white space stands beside it.
        self.unsafe = re.compile(r"[ \n][\s\x1c-\x1f\x85]|[^\S \n][ \n]|[ \n]\Z|\A\n|\0")
        self.blank = re.compile(r"[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
        self.kept: int | None = None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.how == "whole":
            return
        mark = next(x for x in rules["added_tokens"] if x["special"])
        self.mixed = (Tokenizer.from_file(path), mark["content"], mark["id"])
        # For letters alone no pattern has to find the pre-tokens: cut at line breaks.
        plain = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": "\n"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        steps = [x for x in (rules["normalizer"] or {}).get("normalizers", []) if x["type"] != "Replace"]
        letters = Tokenizer.from_str(json.dumps(rules | {"added_tokens": [], "pre_tokenizer": plain, "normalizer": {"type": "Sequence", "normalizers": steps} if steps else None}))
        at = letters.encode("\n", add_special_tokens=False).ids
        self.letters = (letters, "\n", at[0]) if len(at) == 1 else self.mixed

    @staticmethod
    def _how(rules: dict) -> str:
        """led: a space belongs to the piece after it; dropped: no pre-token holds white space; whole: texts aren't cut."""
        pre, norm, post = rules["pre_tokenizer"] or {}, rules["normalizer"], rules["post_processor"]
        special = [x for x in rules["added_tokens"] if x["special"]]
        if not special or any(x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"] for x in rules["added_tokens"]) or post and post["type"] != "ByteLevel":
            return "whole"
        parts = pre.get("pretokenizers", [pre])
        if len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0]["use_regex"] and not parts[0]["add_prefix_space"] and norm is None:
            return "led"
        known = {"NFC", "Replace", "Lowercase"}
        if len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "") and " ?" not in parts[0]["pattern"]["Regex"] and parts[1]["type"] == "ByteLevel" and norm and norm["type"] == "Sequence" and all(x["type"] in known and (x["type"] != "Replace" or x["pattern"] == {"Regex": r"\s+"}) for x in norm["normalizers"]):
            return "dropped"
        return "whole"

    def cuttable(self, text: str) -> bool:
        if self.how == "whole" or any(x in text for x in self.added):
            return False
        if self.how == "dropped":
            return True
        odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text.endswith((" ", "\n")) or text.startswith("\n") or self.blank.search(text)
        return not (odd and self.unsafe.search(text))

    def pieces(self, texts: list[str]) -> pa.LargeListArray | pa.ListArray:
        """The pieces of texts that can be cut."""
        x = pa.array(texts, pa.large_string())
        if self.how == "dropped":
            return pc.split_pattern(pc.replace_substring(x, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(x, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def joined(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts that can be cut."""
        cut = self.pieces(texts)
        numbered = cut.flatten().dictionary_encode()
        number, different = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(set(different))
        known = [*map(self.known.__getitem__, different)]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at, ids = np.cumsum(size) - size, np.frombuffer(b"".join(known), "<u4")
        out, ends = [], [np.zeros(1, np.int64)]
        for i in range(0, len(number), AT_ONCE):
            some = number[i : i + AT_ONCE]
            n = size[some]
            end = np.cumsum(n)
            out.append(ids[np.repeat(at[some] - (end - n), n) + np.arange(end[-1])])
            ends.append(end + ends[-1][-1])
        ids = np.concatenate(out)
        bounds = np.concatenate(ends)[cut.offsets.to_numpy()].tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b].tobytes()

    def _encode(self, todo: list[str], by: tuple) -> None:
        tokenizer, mark, mark_id = by
        blocks = [todo[i : i + CALL] for i in range(0, len(todo), CALL)]
        for block, e in zip(blocks, tokenizer.encode_batch_fast([mark.join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(ids == mark_id) * 4
            data = ids.tobytes()
            self.known.update(zip(block, [data[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(data)], strict=True)], strict=True))

    def learn(self, need: set[str]) -> None:
        """Sees to it that known holds all of need."""
        if len(self.known) > (self.kept or KEPT):
            self.known, self.older = {}, self.known
        new, older = need.difference(self.known), self.older
        if not new:
            return
        for w in [w for w in new if w in older]:
            self.known[w] = older[w]
            new.discard(w)
        ended = []
        for w in [w for w in new if w[-1:] in _MARKS]:
            if m := _ENDED.fullmatch(w):
                ended.append((w, m[1], m[2]))
                new.discard(w)
        for x in {x for _, *parts in ended for x in parts}:
            if x not in self.known:
                if x in older:
                    self.known[x] = older[x]
                else:
                    new.add(x)
        letters = [*filter(_LETTERS.fullmatch, new)]
        new.difference_update(letters)
        self._encode(letters, self.letters)
        self._encode([*new], self.mixed)
        for w, x, y in ended:
            self.known[w] = self.known[x] + self.known[y]

    def encoded(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids, little-endian unsigned 32-bit integers; null is the empty text."""
        block: list[str] = []
        held = 0

        def out() -> Iterator[bytes]:
            cut = [self.cuttable(t) for t in block]
            joined = self.joined([t for t, c in zip(block, cut, strict=True) if c]) if any(cut) else iter(())
            for t, c in zip(block, cut, strict=True):
                yield next(joined) if c else np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()

        for t in texts:
            t = t or ""
            if block and (len(block) == GATHER or held + len(t) > CHARACTERS):
                yield from out()
                block, held = [], 0
            block.append(t)
            held += len(t)
        yield from out()


def released() -> None:
    """Gives memory that earlier tasks of this worker process have freed back to the machine, where that can be asked for."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def encoder(path: str, kept: int | None = None) -> Encoder:
    """One a worker process. kept: so many pieces instead of KEPT, where memory is scarcer than time."""
    if path not in _ENCODERS:
        released()
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].kept = kept
    return _ENCODERS[path]


def forget() -> None:
    """Drops what this worker process keeps of encoders; tasks that need the memory for other things call it."""
    _ENCODERS.clear()
    released()


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; it is the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""From text to pretokens: special strings, then what the tokenizer file says of normaliser and split.

`Pretokens` splits whole pieces: those of common Latin characters by the file's own pattern here, any other through
the tokenizers library's normaliser and pretokenizer. `Splitter` does the same character by character, as a
deterministic machine; it asks the library for the class of each character, so that its Unicode tables decide.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import regex

from .stores import held

#: Fixed value: the split pattern of byte-level pretokenizers.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the split pattern of pretokenizers that drop white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_COMMON = re.compile("[\\t\\n\\r\\x20-\\x7e¡-ɏ]*")


def byte_letters() -> list[str]:
    """Byte-level models write each byte as one visible character: itself where visible, else the next free one from 256."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Pretokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special_ids = {x["content"]: x["id"] for x in spec["added_tokens"]}
        special = sorted(self.special_ids, key=len, reverse=True)
        self.angular = all(x.startswith("<") for x in special)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        patterns = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
        patterns += [BYTE_LEVEL_SPLIT for p in parts if p["type"] == "ByteLevel" and p["use_regex"]]
        normalisers = spec["normalizer"] or {"type": "None"}
        kinds = [n["type"] for n in normalisers.get("normalizers", [normalisers])]
        self.pattern = patterns[0] if len(patterns) == 1 else None
        #: Only these steps are known to act on common characters as lower() does, or not at all.
        self.quick = regex.compile(patterns[0]) if len(patterns) == 1 and kinds in (["None"], ["NFC", "Replace", "Lowercase"]) else None
        self.lower = "Lowercase" in kinds
        self.spaces = self.pattern == BYTE_LEVEL_SPLIT
        self.known = self.quick is not None and self.pattern in (BYTE_LEVEL_SPLIT, WORD_SPLIT)
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}

    def of(self, piece: str) -> list[bytes | int]:
        """Pretokens as UTF-8, special strings as their ids, in order."""
        word = piece[1:] if piece[:1] == " " and self.spaces else piece
        if self.known and word.isascii() and word.isalpha():  # one run of letters
            return [(piece.lower() if self.lower else piece).encode()]
        if "<" not in piece and self.angular:
            return self._plain(piece)
        out: list[bytes | int] = []
        at = 0
        for m in self.special_in(piece):
            out += [*self._plain(piece[at : m.start()]), self.special_ids[m[0]]]
            at = m.end()
        return out + self._plain(piece[at:])

    def special_in(self, text: str) -> list[re.Match]:
        return list(self.special.finditer(text)) if self.special else []

    def normalised(self, text: str) -> str:
        """A whole text as the file's normaliser gives it."""
        if self.tokenizer.normalizer is None or not text:
            return text
        if self.quick and _COMMON.fullmatch(text):
            return text.lower() if self.lower else text
        return self.tokenizer.normalizer.normalize_str(text)

    def _plain(self, text: str) -> list[bytes | int]:
        if self.quick and _COMMON.fullmatch(text):
            return [x.encode() for x in self.quick.findall(text.lower() if self.lower else text)]
        if text and self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if text else []
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in split]


#: States of the splitter: nothing open; a run of letters, numbers, other signs; then ("'", what follows it) while it
#: may become an ending like 's or 're, and (" ", the last white space, whether white space before it is in a pretoken).
FREE, LETTERS, NUMBERS, OTHERS, SPACE = "free", "letters", "numbers", "others", "space"
#: Kept transitions.
KEEP_MOVES = 200_000


class Splitter:
    """Pretokens of a normalised text, one character at a time; it holds back two characters at most.

    A transition gives parts in order: bytes that belong to the open pretoken, and None where the pretoken ends.
    """

    def __init__(self, pretokens: Pretokens):
        if pretokens.pattern not in (BYTE_LEVEL_SPLIT, WORD_SPLIT):
            raise ValueError("only for files that split like BYTE_LEVEL_SPLIT or WORD_SPLIT")
        self.spaces = pretokens.pattern == BYTE_LEVEL_SPLIT
        self.tokenizer = pretokens.tokenizer
        self.classes: dict[str, str] = {}
        self.moves: dict[tuple, tuple] = {}

    def _class(self, c: str) -> str:
        kind = self.classes.get(c)
        if kind is None:

            def pieces(text: str) -> int:
                return len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

            if pieces("a" + c) == 1 and pieces(c):
                kind = LETTERS
            elif pieces("!" + c) == 1 and pieces(c):
                kind = OTHERS
            else:
                kind = NUMBERS if (pieces("1" + c) == 1 if self.spaces else pieces(c)) else SPACE
            self.classes[c] = kind
        return kind

    def step(self, mode: str | tuple, c: str) -> tuple:
        """The next state and the parts."""
        move = self.moves.get((mode, c))
        if move is None:
            if len(self.moves) >= KEEP_MOVES:
                self.moves.clear()
            move = self.moves[mode, c] = self._move(mode, c)
        return move

    def _move(self, mode: str | tuple, c: str) -> tuple:
        kind, raw = self._class(c), c.encode()
        if mode == FREE:
            if kind == SPACE:
                return ((" ", c, False), ()) if self.spaces else (FREE, ())
            if c == "'":
                return ("'", ""), ()
            if kind == NUMBERS and not self.spaces:
                return FREE, (raw, None)
            return kind, (raw,)
        if isinstance(mode, str):
            if kind == mode:
                return mode, (raw,)
            return self._after((None,), FREE, c)
        if mode[0] == "'":
            if not mode[1]:
                if c in "stmd":
                    return FREE, (b"'" + raw, None)
                if c in "rvl":
                    return ("'", c), ()
                return (OTHERS, (b"'" + raw,)) if kind == OTHERS else self._after((b"'", None), FREE, c)
            if mode[1] + c in ("re", "ve", "ll"):
                return FREE, (b"'" + mode[1].encode() + raw, None)
            return self._after((b"'", None, mode[1].encode()), LETTERS, c)
        _, held, begun = mode
        if kind == SPACE:
            return (" ", c, True), (held.encode(),)
        before = (None,) if begun else ()
        if held == " ":
            return kind, (*before, b" " + raw)
        return self._after((*before, held.encode(), None), FREE, c)

    def _after(self, parts: tuple, mode: str, c: str) -> tuple:
        nxt, more = self._move(mode, c)
        return nxt, (*parts, *more)

    def ending(self, mode: str | tuple) -> tuple:
        """The parts that the end of the text brings."""
        if isinstance(mode, str):
            return () if mode == FREE else (None,)
        if mode[0] == "'":
            return (b"'", None, mode[1].encode(), None) if mode[1] else (b"'", None)
        return mode[1].encode(), None


class Normalised:
    """A text's characters after the file's normaliser, as they come: it holds a character until the next that can't join it."""

    def __init__(self, pretokens: Pretokens):
        self.normalizer = pretokens.tokenizer.normalizer
        self.held, self.known = "", {}

    def feed(self, text: str) -> str:
        if self.normalizer is None:
            return text
        out = []
        for c in text:
            if self.held and not joins(c):
                out.append(self._made(self.held))
                self.held = ""
            self.held += c
        return "".join(out)

    def end(self) -> str:
        held, self.held = self.held, ""
        return self._made(held) if held else ""

    def _made(self, cluster: str) -> str:
        made = self.known.get(cluster)
        if made is None:
            made = self.normalizer.normalize_str(cluster)
            if len(self.known) < KEEP_MOVES and len(cluster) < 8:
                self.known[cluster] = made
        return made


def joins(c: str) -> bool:
    """Whether normalising may join the character to one before it: marks, and the later letters of a Korean syllable."""
    return c >= "̀" and (unicodedata.category(c)[0] == "M" or unicodedata.combining(c) > 0 or "ᅠ" <= c <= "ᇿ" or c >= "\U00010000" and unicodedata.normalize("NFC", c) != c)


def pretokens(path: str) -> Pretokens:
    """One for each worker process and file, while it works for the same operator."""
    return held(("pretokens", path), lambda: Pretokens(path))

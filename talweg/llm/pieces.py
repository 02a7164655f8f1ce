"""Splitting texts into pre-tokens, with the Unicode classes that the tokenizers' own libraries have."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

#: Characters that one probe of a library looks at.
BLOCK = 2048


def _blocks() -> Iterator[str]:
    """Every character but surrogates, in blocks."""
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    return ("".join(map(chr, codes[i : i + BLOCK])) for i in range(0, len(codes), BLOCK))


def _ranges(chars: Iterable[str]) -> str:
    """Characters as the inside of a bracket expression."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _classes(matched: Callable[[str], Callable[[str], str]]) -> dict[str, str]:
    """The classes L, N and white space as a library matches them: ``matched(pattern)(text)`` is what it finds in a text."""
    found = {}
    for name, pattern in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
        find = matched(pattern)
        found[name] = _ranges("".join(map(find, _blocks())))
    return found


@lru_cache(maxsize=1)
def tiktoken_classes() -> dict[str, str]:
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def matched(pattern: str) -> Callable[[str], str]:
        library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return lambda text: bytes(library.encode_ordinary(text)).decode()

    return _classes(matched)


@lru_cache(maxsize=1)
def tokenizers_classes() -> dict[str, str]:
    from tokenizers import Regex, pre_tokenizers

    def matched(pattern: str) -> Callable[[str], str]:
        library = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        return lambda text: "".join(piece for piece, _ in library.pre_tokenize_str(text))

    return _classes(matched)


def spelled_out(pattern: str, classes: dict[str, str]) -> tuple[str, str]:
    """A pattern that uses the classes L and N, and white space, with explicit ranges in their place: all of them, and those
    of the basic plane alone, which say the same of texts within that plane."""

    def with_ranges(letters: str, numbers: str, spaces: str) -> str:
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        return inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")

    names = ("L", "N", "S")
    return with_ranges(*(classes[n] for n in names)), with_ranges(*(basic(classes[n]) for n in names))


def basic(ranges: str) -> str:
    """The part of ranges that is within the basic plane."""
    return _ranges(c for c in re.compile(f"[{ranges}]").findall("".join(map(chr, range(0x10000)))))


def splitter(patterns: tuple[str, str]) -> Callable[[str], list[str]]:
    """findall of a spelled-out pattern. ``re`` looks a character of the basic plane up in a bitmap and goes through the ranges of the
    other planes one by one, so texts without characters of these are matched without their ranges."""
    every, plane = (re.compile(p).findall for p in patterns)
    beyond = re.compile("[\U00010000-\U0010ffff]").search

    def split(text: str) -> list[str]:
        return every(text) if beyond(text) else plane(text)

    return split

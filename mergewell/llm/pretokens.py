"""Pre-tokens of whole texts, as a tokenizer file of a known kind defines them.

The file's normaliser and split rule must be those stated here; a file with others is refused, since its
pre-tokens would be wrong.  Texts are cut at blanks, tabs and line breaks, which no pre-token crosses and
across which nothing is normalised.  The chunks between are split here where they hold plain Latin
characters only, for which the rules of Python's ``regex`` and of the tokenizer library agree; the others -
other scripts, curly quotes, emoji - by the library's own normaliser and pre-tokenizer.  A chunk that holds a
special token's string has no pre-tokens of its own and is left to the library as a whole.

Long chunks, as of scripts without blanks, are cut further between a mark of punctuation and a letter, where
one pre-token ends in any case.  What can't be cut is worked on as a whole.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's own normalisation and split rule, as its file states them (fixed values).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile("[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")
BLANK = regex.compile("[ \t\n\r]")
#: Where a long chunk may be cut: nothing is normalised across these, and the pre-token before ends.
SEAM = regex.compile("(?<=[。，、！？；：,.;:!?])(?=[A-Za-zぁ-ゖァ-ヺ一-鿿])")
PIECE = 1 << 20
LONG = 1 << 10


def pieces(text: str, most: int | None = None) -> Iterator[str]:
    """The text in pieces of about a million characters, cut at single blanks, which are left out."""
    most, at = most or PIECE, 0
    while len(text) - at > most:
        cut = BLANK.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def chunks(piece: str) -> list[str]:
    """What stands between blanks, none of it empty; long chunks are cut at their seams."""
    found = [c for c in piece.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if c]
    if found and len(max(found, key=len)) > LONG:
        return [part for c in found for part in (SEAM.split(c) if len(c) > LONG else [c])]
    return found


def check(path: str) -> dict:
    """The rules in the tokenizer's file; refused if its pre-tokens are not those that are split here."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    steps = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
    added = [t for t in rules["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or BLANK.search(t["content"])]
    if steps != NORMALIZERS or split != SPLIT.pattern or added or rules.get("post_processor"):
        raise ValueError(f"{path}: another normaliser, split rule or kind of special token than this operator's")
    return rules


class Splitter:
    """Splits chunks into pre-tokens; holds the library's tokenizer for what isn't plain."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        rules = check(path)
        #: what the file says, without its long lists
        self.rules = rules | {"model": {k: v for k, v in rules["model"].items() if k not in ("vocab", "merges")}}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The library writes each byte of a pre-token as one character: printable ones as themselves, others from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte_of = {c: b for b, c in self.letters.items()}

    def special(self, chunk: str) -> bool:
        return any(s in chunk for s in self.specials)

    def plain(self, text: str) -> bool:
        """Whether all chunks of the text can be split here."""
        return PLAIN.fullmatch(text) is not None and not self.special(text)

    def split(self, chunk: str, plain: bool = False) -> list[str] | None:
        """The chunk's pre-tokens in order; None if it holds a special string.  ``plain``: it is known to be."""
        if plain:
            return SPLIT.findall(chunk.lower())
        if self.special(chunk):
            return None
        if PLAIN.fullmatch(chunk) is not None:
            return SPLIT.findall(chunk.lower())
        normal = self.tokenizer.normalizer.normalize_str(chunk)
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """This worker's splitter for a tokenizer file."""
    if path not in _splitters:
        _splitters.clear()
        _splitters[path] = Splitter(path)
    return _splitters[path]


def summaries(path: str, entries: int):
    """For ``mapInArrow`` over a text column: a task's most frequent pre-tokens, at most ``entries`` of them.

    Counting is lossy, as bounded tables must be: a full table of chunks goes to that of pre-tokens without
    what it met once, and a full table of pre-tokens drops what is surely rare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(path)
        counts: Counter[str] = Counter()
        met: Counter[str] = Counter()
        floor = 0  # what an entry may have lost to earlier pruning

        def add(least: int) -> None:
            nonlocal counts, floor
            for chunk, n in met.items():
                if n >= least:
                    for p in own.split(chunk) or ():
                        counts[p] += n
            met.clear()
            while len(counts) > 16 * entries:
                floor += 1
                counts = Counter({k: n for k, n in counts.items() if n > floor})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in pieces(text or ""):
                    met.update(chunks(piece))
                if len(met) > 16 * entries:
                    add(2)
        add(1)
        top = counts.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    return run


def frequent(texts: DataFrame, path: str, most: int, task_entries: int) -> list[str]:
    """At most ``most`` frequent pre-tokens of ``texts (text)``, of all scripts, by the tasks' summaries."""
    found = texts.mapInArrow(summaries(path, task_entries), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in found.orderBy(F.desc("n"), "piece").limit(most).collect()]

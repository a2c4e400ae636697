"""BPE encoding as a bounded-lookahead transducer, and decoding as a byte-to-text state machine.

A merge of a token with its neighbours can only be undone by an earlier merge that takes one of its parts to the
right, which in turn depends on what stands further right. Following these dependencies in merge order gives, for
every merge, how many symbols behind it decide it; the largest is the merge list's lookahead. A token that ends at
least that far before the end of the read part of a word can never change, so it is emitted, and only the rest is
kept: memory is bounded by the lookahead and one chunk, however long a word is. Words that end earlier are merged
whole, and the words of a task are remembered in a table of bounded size.

Defined results: a null or empty text has no tokens; repeated rows are encoded each; other columns play no part.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the normaliser's and the splitter's \s (Unicode's White_Space). Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The tokenizer file's split pattern with \s written out. Fixed values.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: str.split() also splits at these, which are no white space to the splitter.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
RUNS = regex.compile(rf"[^{SPACE}]+")
END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is a visible Latin-1 letter, else the next one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in seen:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Model:
    """Vocabulary and merges of a tokenizer file of the kind BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.names = {i: t for t, i in {**self.ids, **self.specials}.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        #: What each merge makes, by rank: one string a token, whose hash is worked out once.
        self.merged = [a + b for a, b in pairs]
        self.letters = byte_letters()
        self.lookahead = lookahead(pairs, self.end)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None


def lookahead(pairs: list[tuple[str, str]], end: str = "") -> int:
    """Symbols behind a token's end that decide whether it stays.

    ``need[r]`` is that number for the token of merge ``r`` at the time of the merge: its right part may lack a
    partner because an earlier merge took it (``taken``), may itself need symbols to be formed (``formed``), and the
    same holds for its left part, less the right part's length.
    """
    size = lambda t: len(t) - (len(end) if end and t.endswith(end) else 0)
    taken: dict[str, int] = {}
    formed: dict[str, int] = {}
    for left, right in pairs:
        n = size(right)
        need = max(0, formed.get(right, 0), taken.get(right, 0), formed.get(left, 0) - n, taken.get(left, 0) - n)
        taken[left] = max(taken.get(left, 0), n + need)
        formed[left + right] = max(formed.get(left + right, 0), need)
    return max([1, *taken.values(), *formed.values()])


def merge(symbols: list[str], ranks: dict) -> list[str]:
    """Apply the merges in order of rank, leftmost first."""
    n = len(symbols)
    if n < 2:
        return symbols
    parts, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j], right[i] = a + b, None, right[j]
        if right[j] < n:
            left[right[j]] = i
            if (r := ranks.get((parts[i], parts[right[i]]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[right[i]]))
        if left[i] >= 0 and (r := ranks.get((parts[left[i]], parts[i]))) is not None:
            heapq.heappush(heap, (r, left[i], parts[left[i]], parts[i]))
    return [p for p in parts if p is not None]


def merge_short(symbols: list[str], ranks: dict, merged: list[str]) -> list[str]:
    """``merge`` for short words: the ranks of all neighbours stand in a list, whose minimum is looked for again after each merge."""
    never = len(merged)
    found = [ranks.get(p, never) for p in zip(symbols, symbols[1:])]
    while found and (r := min(found)) != never:
        i = found.index(r)
        symbols[i : i + 2] = (merged[r],)
        del found[i]
        if i:
            found[i - 1] = ranks.get((symbols[i - 1], symbols[i]), never)
        if i < len(found):
            found[i] = ranks.get((symbols[i], symbols[i + 1]), never)
    return symbols


class Transducer:
    """Encodes one word that arrives in chunks of letters; ``push`` returns tokens that can no longer change."""

    def __init__(self, model: Model, chunk: int = 4096):
        self.model, self.kept, self.chunk = model, "", chunk

    def push(self, letters: str) -> list[str]:
        self.kept += letters
        out = []
        # The last letter stays: it may turn out to be the one with the word's end.
        if len(self.kept) > 2 * self.model.lookahead + self.chunk:
            tokens = merge(list(self.kept), self.model.ranks)
            limit, at = len(self.kept) - self.model.lookahead - 1, 0
            for t in tokens:
                if at + len(t) > limit:
                    break
                at += len(t)
                out.append(t)
            self.kept = self.kept[at:]
        return out

    def close(self) -> list[str]:
        symbols, self.kept = list(self.kept), ""
        if symbols:
            symbols[-1] += self.model.end
        return merge(symbols, self.model.ranks)


def word_tokens(model: Model, word: str) -> Iterator[str]:
    """Tokens of one word, emitted as soon as they are stable. A word shorter than the lookahead ends before any of them is."""
    if len(data := word.encode()) <= model.lookahead:
        symbols = list(map(model.letters.__getitem__, data))
        symbols[-1] += model.end
        yield from merge_short(symbols, model.ranks, model.merged)
        return
    machine, step = Transducer(model), 4096
    for lo in range(0, len(data), step):
        yield from machine.push("".join(map(model.letters.__getitem__, data[lo : lo + step])))
    yield from machine.close()


def normal(text: str) -> str:
    """Canonical composition, then lower case letter by letter (no final sigma)."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def split_words(run: str) -> list[str]:
    """Words of a run. Latin letters, with or without one ASCII sign behind them, need no pattern: below U+0250 ``isalpha`` is \\p{L}."""
    body = run if (last := run[-1]).isalnum() or last > "~" else run[:-1]
    if body.isalpha() and (body.isascii() or max(body) < "\u0250"):
        return [run] if body is run else [body, last]
    return WORDS.findall(run)


class Encoder(dict):
    """Run of letters without white space -> its token ids as text; at most ``limit`` runs are remembered, in two halves: those not
    asked for while the newer half filled up are forgotten."""

    def __init__(self, model: Model, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.model, self.limit, self.longest, self.older = model, limit, longest, {}

    def __missing__(self, run: str) -> str:
        if (said := self.older.get(run)) is None:
            words = split_words(run)
            if words == [run]:
                ids = self.model.ids
                said = " ".join([str(ids[t]) for t in word_tokens(self.model, run) if t in ids])
            else:  # The words of a run are remembered as well: each is a run of one word.
                said = " ".join(filter(None, map(self.__getitem__, words)))
        if len(run) <= self.longest:
            if len(self) >= max(1, self.limit // 2):
                self.older = dict(self)
                self.clear()
            self[run] = said
        return said

    def runs(self, text: str) -> Iterable[str]:
        text = normal(text)
        return RUNS.findall(text) if ODD_SPACE.search(text) else text.split()

    def encode(self, text: str) -> str:
        """Ids of the whole text in decimals with one space between them."""
        model = self.model
        if model.special_pattern is None or not (marks := list(model.special_pattern.finditer(text))):
            return " ".join(map(self.__getitem__, self.runs(text)))
        parts, at = [], 0
        for m in marks:
            parts += map(self.__getitem__, self.runs(text[at : m.start()]))
            parts.append(str(model.specials[m[0]]))
            at = m.end()
        parts += map(self.__getitem__, self.runs(text[at:]))
        return " ".join(p for p in parts if p)


class Decoder:
    """Token by token to text: letters become bytes, bytes become text as soon as a character is whole, a word's end becomes a space."""

    def __init__(self, model: Model):
        self.model, self.state = model, codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes = {c: b for b, c in enumerate(model.letters)}

    def push(self, token: int) -> str:
        name = self.model.names[token]
        if token in self.model.specials.values():
            return self.state.decode(b"", True) + name
        ends = self.model.end and name.endswith(self.model.end)
        out = self.state.decode(bytes(self.bytes[c] for c in (name[: -len(self.model.end)] if ends else name)), bool(ends))
        return out + " " if ends else out

    def close(self) -> str:
        return self.state.decode(b"", True)


def plain_text(model: Model, ids: Iterable[int]) -> str:
    machine = Decoder(model)
    return ("".join(map(machine.push, ids)) + machine.close()).removesuffix(" ")


_models: dict[str, tuple[Model, Encoder, dict]] = {}


def loaded(path: str) -> tuple[Model, Encoder, dict]:
    if path not in _models:
        model = Model(path)
        _models[path] = model, Encoder(model), {str(i): t for i, t in model.names.items()}
    return _models[path]


def encode(docs: DataFrame, tokenizer: str, ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also token_ids (array of int).

    The decoded text is what the tokenizers library's ``decode`` gives for a file without a decoder: the tokens'
    own texts with one space between them. ``plain_text`` decodes to readable text.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * ids

    def run(batches):
        model, encoder, texts = loaded(tokenizer)
        for batch in batches:
            counts, first, second, all_ids = [], [], [], []
            for value in batch.column("text"):
                said = encoder.encode(value.as_py() or "")
                tokens = said.split()
                counts.append(len(tokens))
                said = " ".join(tokens) if "  " in said or said[:1] == " " or said[-1:] == " " else said
                first.append(hashlib.sha256(said.encode()).hexdigest())
                second.append(hashlib.sha256(" ".join(map(texts.__getitem__, tokens)).encode()).hexdigest())
                if ids:
                    all_ids.append(np.array(tokens, dtype=np.int32) if tokens else np.zeros(0, np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int32()))] * ids, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

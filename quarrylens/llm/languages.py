"""Languages of documents and of their passages, by compression.

For each language a zstandard dictionary of raw content is cut from a bounded
sample of labelled documents. A sentence belongs to the language whose dictionary
makes it smallest; where the two smallest sizes are close, none is given. Sentences
are taken from whole texts; code, quoted messages, paths, names and titles are
blanked out first. A document's languages are those of its whole sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from quarrylens.llm.files import spread

#: About so many labelled documents per language are sampled (by a hash of the id), none longer than this.
SAMPLE_DOCS = 400
SAMPLE_MAX_CHARS = 6000
#: Bytes of one language's dictionary.
DICTIONARY_BYTES = 120_000
#: A sentence is judged if it has so many letters (ideographs and kana count double) ...
MIN_LETTERS = 12
#: ... and its language holds if the runner-up is larger by this share and by this many bytes.
MIN_MARGIN = 0.06
MIN_BYTES = 3

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_QUOTES = re.compile(r"""`[^`\n]*`|"[^"\n]*"|“[^”\n]*”|„[^“”"\n]*[“”"]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』""")
_BLANKED = re.compile(
    r"""(?x)
    [A-Za-z][A-Za-z0-9_+.-]*://[!-~]+ | [A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+ | @[a-z]+\b
    | (?<![A-Za-z0-9_/])(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]*[A-Za-z0-9_]
    | [A-Za-z0-9_-]+\.(?:java|jsx?|tsx?|json|md|ya?ml|sql|py|xml|txt)\b
    | [A-Za-z_$][A-Za-z0-9_$]*\(\)? (?:\))? | [A-Za-z]*[a-z0-9][A-Z][A-Za-z0-9]* | [A-Za-z]+_[A-Za-z0-9_]+ | [A-Za-z_]*[0-9][A-Za-z0-9_.]*
    """,
)
#: A name behind a mention at the end of a line belongs to it.
_MENTION = re.compile(r"(?m)@[a-z]+[ ][a-z]+$")
_PIECE = re.compile(r"\S+")
_BREAK = re.compile(r"^[ \t]*(?:[-*+•>]+[ \t]+|\d+[.)][ \t]+)")
_TITLE = re.compile(r"^[ \t]*(?:\#{1,6}[ \t]|={3,}|-{3,}[ \t]*$|v?\d+(?:\.\d+)+[ \t]*$)")
_END = re.compile(r"[.!?…]+[\"')\]»”]*(?=\s|$)|[。！？]+[」』）]*")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def _without_names(m: re.Match) -> str:
    """A piece between white space with its code, paths and names blanked; most pieces are plain words."""
    piece = m.group()
    bare = piece.rstrip(".,;:!?")
    if bare.isalpha() and (bare.islower() or bare.istitle()):
        return piece
    return _BLANKED.sub(lambda x: " " * len(x.group()), piece)


def sentences(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, bare text, ended by a mark) of each sentence; bare text is lower-case, without code and names.

    Lines that begin a list item or follow a blank line, title or code begin a new
    sentence; other line ends are white space. Titles are skipped.
    """
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    masked = _FENCE.sub(blank, text) if "```" in text or "~~~" in text else text
    spaces = lambda m: " " * len(m.group())
    masked = _QUOTES.sub(spaces, masked)
    if "@" in masked:
        masked = _MENTION.sub(spaces, masked)
    masked = _PIECE.sub(_without_names, masked)
    blocks: list[tuple[int, int]] = []
    start = None
    at = 0
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        stripped = line.strip()
        if not stripped or _TITLE.match(line) or not masked[at:end].strip():
            if start is not None:
                blocks.append((start, at))
                start = None
        elif _BREAK.match(line):
            if start is not None:
                blocks.append((start, at))
            start = at + _BREAK.match(line).end()
        elif start is None:
            start = at
        at = end
    if start is not None:
        blocks.append((start, at))
    found = []
    for a, b in blocks:
        pos = a
        for m in _END.finditer(masked, a, b):
            found.append((pos, m.end(), True))
            pos = m.end()
        if masked[pos:b].strip():
            found.append((pos, b, False))
    out = []
    for a, b, ended in found:
        bare = re.sub(r"[^\w']+", " ", masked[a:b]).strip().lower()
        if bare:
            lead = len(text[a:b]) - len(text[a:b].lstrip())
            out.append((a + lead, b, bare, ended))
    return out


def letters(bare: str) -> int:
    return sum(2 if _WIDE.match(c) else 1 for c in bare if c.isalpha())


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _features(bare: str) -> list[str]:
    if _WIDE.search(bare):
        dense = bare.replace(" ", "")
        return [dense[i:i + 2] for i in range(len(dense) - 1)]
    return bare.split()


def _clean(by_lang: dict[str, list[str]]) -> dict[str, list[str]]:
    """Drop sample sentences whose words speak for another language than their document's label."""
    langs = list(by_lang)
    words: dict[str, int] = {}
    split = {s: [words.setdefault(w, len(words)) for w in _features(s)] for rows in by_lang.values() for s in rows}
    counts = np.zeros((max(1, len(words)), len(langs)))
    for j, lang in enumerate(langs):
        seen = [i for s in by_lang[lang] for i in split[s]]
        counts[:, j] += np.bincount(np.array(seen, dtype=np.int64), minlength=len(counts))
    weight = np.log((counts + 0.1) / (counts.sum(axis=0) + 1000))
    best = {s: langs[int(weight[ids].sum(axis=0).argmax())] for s, ids in split.items() if ids}
    return {lang: [s for s in rows if best.get(s) == lang] for lang, rows in by_lang.items()}


def script(bare: str) -> str:
    """The script most letters are of: wide (ideographs and kana), cyrillic or latin (all others)."""
    wide = len(_WIDE.findall(bare))
    cyrillic = len(_CYRILLIC.findall(bare))
    rest = sum(map(str.isalpha, bare)) - wide - cyrillic
    return max((rest, "latin"), (cyrillic, "cyrillic"), (2 * wide, "wide"))[1]


def train(sample: list[tuple[str, str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary content per language from (language, text) pairs, each sentence once, with and without accents."""
    by_lang: dict[str, list[str]] = defaultdict(list)
    for lang, text in sample:
        by_lang[lang] += [s for _, _, s, _ in sentences(text) if letters(s) >= MIN_LETTERS]
    content = {}
    for lang, rows in _clean(by_lang).items():
        parts, used = [], 0
        for s in dict.fromkeys(rows):
            for form in dict.fromkeys((s, without_accents(s))):
                raw = (form + "\n").encode()
                if used + len(raw) <= size:
                    parts.append(raw)
                    used += len(raw)
        content[lang] = b"".join(reversed(parts))
    return content


class Classifier:
    """Sizes of a sentence under the dictionary of every language that is written in its script."""

    def __init__(self, content: dict[str, bytes], level: int = 3, cache: int = 200_000) -> None:
        self.compressors: dict[str, dict[str, zstandard.ZstdCompressor]] = defaultdict(dict)
        for lang, raw in sorted(content.items()):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors[script(raw.decode())][lang] = zstandard.ZstdCompressor(
                dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.cache: dict[str, tuple[str | None, float]] = {}
        self.limit = cache

    def language(self, bare: str) -> tuple[str | None, float]:
        """Language and margin of a bare sentence; None where it is short or the two best are close."""
        known = self.cache.get(bare)
        if known is not None:
            return known
        result: tuple[str | None, float] = (None, 0.0)
        if letters(bare) >= MIN_LETTERS and (compressors := self.compressors.get(script(bare))):
            raw = bare.encode()
            sizes = sorted((len(c.compress(raw)), lang) for lang, c in compressors.items())
            (best, lang), (second, _) = sizes[0], sizes[1] if len(sizes) > 1 else (len(raw), "")
            margin = (second - best) / second
            result = (lang if margin >= MIN_MARGIN and second - best >= MIN_BYTES else None, margin)
        if len(self.cache) >= self.limit:
            self.cache.clear()
        self.cache[bare] = result
        return result

    def passages(self, text: str) -> list[tuple[int, int, str, float, int]]:
        """(start, end, language, confidence, sentences): neighbouring sentences of one language together.

        A sentence without a language ends no passage: between two sentences of one
        language it lies inside theirs, elsewhere it belongs to none.
        """
        out: list[list] = []
        for a, b, bare, ended in sentences(text):
            lang, margin = self.language(bare)
            if lang is None:
                continue
            if out and out[-1][2] == lang:
                out[-1][1] = b
                out[-1][3] += margin
                out[-1][4] += 1
            else:
                out.append([a, b, lang, margin, 1])
        return [(a, b, lang, margin / n, n) for a, b, lang, margin, n in out]


def labelled_sample(documents: DataFrame, names: DataFrame, docs: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(language, text) of about `docs` labelled documents per language, drawn by a hash of the id."""
    labelled = with_label_language(documents, names).filter(
        F.col("label_lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_MAX_CHARS))
    counts = {r["label_lang"]: r["count"] for r in labelled.groupBy("label_lang").count().collect()}
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, docs / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    rows = labelled.filter(draw < rate[F.col("label_lang")]).select("doc_id", "label_lang", "text").collect()
    return [(r["label_lang"], r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def with_label_language(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Documents with `label_lang`, the language their label names (spelling and case aside), or null."""
    known = names.select(F.lower(F.trim("label")).alias("_label"), F.col("lang").alias("label_lang")).groupBy("_label").agg(
        F.min("label_lang").alias("label_lang"))
    slim = documents.select("doc_id", "text", F.lower(F.trim("lang")).alias("_label"))
    return slim.join(known, "_label", "left").drop("_label")


def identify(documents: DataFrame, names: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, label_lang, passages array<struct<start_char, end_char, lang, confidence, n_sentences>>.

    Null and empty texts, and texts without a judged sentence, have no passages.
    Without labelled documents of at least two languages nothing is judged. Rows with equal ids are
    judged apart; columns other than doc_id, text and lang are ignored.
    """
    spark = documents.sparkSession
    content = spark.sparkContext.broadcast(train(labelled_sample(documents, names, sample_docs)))
    holder: dict[str, Classifier] = {}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = holder.get("m") or holder.setdefault("m", Classifier(content.value))
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label_lang": batch["label_lang"],
                "passages": [
                    [{"start_char": a, "end_char": b, "lang": lang, "confidence": c, "n_sentences": n}
                     for a, b, lang, c, n in model.passages(t)] if isinstance(t, str) else []
                    for t in batch["text"]],
            })

    rows = with_label_language(spread(documents.select("doc_id", "text", "lang"), "doc_id"), names)
    return rows.select("doc_id", "label_lang", "text").mapInPandas(
        judge,
        "doc_id long, label_lang string, passages array<struct<start_char:int,end_char:int,lang:string,confidence:double,n_sentences:int>>")


def document_languages(identified: DataFrame) -> DataFrame:
    """doc_id, label_lang, lang, n_sentences, confidence: one row per language a document has sentences in."""
    return (
        identified.select("doc_id", "label_lang", F.inline("passages"))
        .groupBy("doc_id", "label_lang", "lang")
        .agg(F.sum("n_sentences").alias("n_sentences"),
             F.round(F.sum(F.col("confidence") * F.col("n_sentences")) / F.sum("n_sentences"), 6).alias("confidence"))
    )


def label_cases(identified: DataFrame) -> DataFrame:
    """doc_id, lang of documents whose label is missing or wrong, or that mix languages."""
    langs = F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["lang"])))
    rows = identified.select("doc_id", "label_lang", langs.alias("langs")).filter(F.size("langs") > 0)
    right = (F.size("langs") == 1) & F.coalesce(F.col("langs")[0] == F.col("label_lang"), F.lit(False))
    return rows.filter(~right).select("doc_id", F.explode("langs").alias("lang")).distinct()

"""Files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

1. One pass over each text finds its line keys and its token composition. A line key
   is the hash of a line together with the line after it, white space aside; that makes
   keys rare outside of copies at any corpus size, without a frequency cap.
2. Files with the same set of keys form one class, so exact copies cost one entry.
3. The inverted index of the keys keeps, per key, two classes of different
   repositories. Each class votes with its keys for classes elsewhere, which takes
   one row per key and class, however many copies there are; the overlap with the
   class voted for most is then counted exactly.
4. A class whose choice falls short, but which has enough keys elsewhere, is compared
   with every class that can hold enough of them: one that does must hold one of its
   rarest keys, of which all but as many as are needed, less one, are looked up.
5. Files that are no copies are judged by their composition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarrylens.session import cut_lineage

#: A file is a copy if this share of its line keys is in one file of another repository ...
MIN_CONTAINMENT = 0.5
#: ... and at least so many keys are shared.
MIN_SHARED_KEYS = 8

# Words of comments that generators write, with their weight; a line with a weight of 1 shows a generator.
_MARK_WORDS = {
    "auto": 0.3, "autogenerated": 0.9, "@generated": 1.0, "automatically": 0.5, "automatisch": 0.5, "automatiquement": 0.5, "automáticamente": 0.5,
    "generated": 0.3, "generiert": 0.6, "erzeugt": 0.6, "généré": 0.6, "generado": 0.6, "produced": 0.3, "created": 0.3, "erstellt": 0.3,
    "overwritten": 0.5, "lost": 0.3, "regenerate": 0.5, "compiler": 0.3, "codegen": 0.3, "generator": 0.3, "source": 0.3,
}
_MARK_PARTICLES = (
    (0.2, frozenset("by from with aus von par por à".split())), (0.2, frozenset("edit modify change bearbeiten ändern modifier editar modificar".split())),
    (0.2, frozenset("not nicht ne no".split())),
)
_MARK_SUBJECTS = frozenset("code file class source module this is was been automatically auto".split())
_SCHEMA_FILE = re.compile(r"(?i)^\S+\.(?:proto|idl|xsd|thrift|wsdl|g4|avsc|graphql)$")
_ANNOTATED = re.compile(r"(?m)^\s*@(?:javax\.annotation\.|jakarta\.annotation\.)?Generated\b")
_BUILT = re.compile(r"(?m)^//[#@] sourceMappingURL=\S+\s*\Z")
_MARK_TOKEN = re.compile(r"@?[^\W\d_][\w.-]*")
_GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:gen|generated|autogen|__generated__|codegen)/|(?:_pb|\.g|\.pb|\.generated)\.\w+$")
_VENDOR_DIR = re.compile(
    r"(?i)(?:^|/)(?:third[_-]?party|node_modules|bower_components|external|extern|deps|vendor|vendored|assets/lib|public/js|static/js|static/lib)/"
    r"(?P<package>[^/]+)?(?P<inside>/)?")
_QUOTED = re.compile(
    r"""(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""",
    re.X,
)
_NUMBER = re.compile(r"\b\d[\w.]*")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBERED_NAME = re.compile(r"[A-Za-z_$]\d")
_DIGITS = re.compile(r"\d+")
_KEYWORDS = frozenset(
    "if else for while return function class const let var new import export try catch throw switch case public private protected "
    "static final void int interface enum extends implements async await this".split()
)
_LOGIC = frozenset("return function if for while".split())


def header_lines(text: str) -> list[str]:
    """Comment lines before the first line of code (package and import lines do not end the header)."""
    lines, inside = [], False
    for line in text.lstrip("﻿").split("\n"):
        s = line.strip()
        if not s:
            continue
        if inside or s.startswith(("//", "/*", "*", "<!--", "#!")):
            lines.append(s)
            inside = (inside or s.startswith("/*")) and "*/" not in s
            if not inside and "*/" in s and s.split("*/", 1)[1].strip():
                break
        elif not re.match(r"(?:package|import)\b|[\"']use strict", s):
            break
    return lines


def composition(text: str) -> dict[str, float]:
    """Shares by which machine-made text shows: literals, numbers, short names, white space, line lengths."""
    comment_chars = string_chars = longest = n_string = 0
    pieces, at = [], 0
    for m in _QUOTED.finditer(text):
        pieces.append(text[at:m.start()])
        at = m.end()
        if m.lastgroup == "comment":
            comment_chars += len("".join(m.group().split()))
        else:
            size = at - m.start()
            n_string += 1
            string_chars += size
            longest = max(longest, size)
    code = " ".join([*pieces, text[at:]])
    numbers = _NUMBER.findall(code)
    words = _WORD.findall(_NUMBER.sub(" ", code))
    n_keyword = sum(w in _KEYWORDS for w in words)
    number_chars = sum(map(len, numbers))
    solid = max(1, len("".join(text.split())))
    dense = max(1, solid - comment_chars)
    lengths = [len(x) for x in text.split("\n") if x.strip()] or [0]
    return {
        "dense": dense, "tokens": n_string + len(numbers) + len(words), "string_share": string_chars / dense,
        "number_share": number_chars / dense, "longest_string": longest, "keywords": n_keyword, "logic": sum(w in _LOGIC for w in words),
        "numbers": len(numbers), "strings": n_string, "words": len(words),
        "short_names": sum(len(w) <= 2 for w in words) / max(1, len(words) - n_keyword), "space": 1 - solid / max(1, len(text)),
        "mean_line": sum(lengths) / len(lengths), "max_line": max(lengths), "n_lines": len(lengths),
    }


def mark_weight(line: str) -> float:
    """How much a comment line's words speak for a generator: the sum over its words, each kind once."""
    lowered = line.lower()
    words = _MARK_TOKEN.findall(lowered.replace("auto-generated", "autogenerated"))
    weight = sum(_MARK_WORDS.get(w.rstrip("."), 0.0) for w in set(words))
    weight += sum(w for w, kinds in _MARK_PARTICLES if not kinds.isdisjoint(x.rstrip(".") for x in words))
    # what was generated: the file itself, or something else it speaks of
    for i, w in enumerate(words):
        if w.rstrip(".") == "generated" and (i == 0 or words[i - 1] in _MARK_SUBJECTS):
            weight += 0.3
            break
    weight += 0.5 * any(_SCHEMA_FILE.match(w.rstrip(".")) is not None for w in words)
    return weight + 0.2 * lowered.lstrip("/*!# ").startswith("<autogenerated" if "<autogenerated" in lowered else "<auto-generated")


def _numbered(text: str) -> tuple[float, int]:
    """Share of lines whose form, numbers masked, recurs in a numbered series, and the number of such forms."""
    forms: dict[str, set[str]] = {}
    n = 0
    for line in text.split("\n"):
        s = line.strip()
        if len(s) < 12:
            continue
        n += 1
        if _NUMBERED_NAME.search(s):
            forms.setdefault(_DIGITS.sub("0", s), set()).add(s)
    series = [len(v) for v in forms.values() if len(v) >= 4]
    return (sum(series) / n, len(series)) if n >= 8 else (0.0, 0)


def rule_class(path: str | None, text: str) -> str | None:
    """generated, minified or data by the composition of the file's tokens; None if none shows.

    Words of the header comment, numbered series of lines, literals, short names and
    line lengths each carry a weight; no single phrase decides, but for an annotation
    or a link to a source map, which tools write for tools.
    """
    if not text.strip():
        return None
    marks = max(map(mark_weight, header_lines(text)), default=0.0)
    share, forms = _numbered(text)
    named = 0.3 if _GENERATED_PATH.search((path or "").replace("\\", "/")) else 0.0
    series = 0.7 * (share > 0.5) + 0.4 * (share > 0.5 and forms >= 2) + 0.3 * (0.25 < share <= 0.5 and forms >= 2)
    if marks + named + series >= 1.0 - 1e-9 and (marks >= 0.7 or series):
        return "generated"
    first_type = re.search(r"\b(?:class|interface|enum|record)\s+\w", text)
    if _ANNOTATED.search(text, 0, first_type.start() if first_type else len(text)):
        return "generated"
    if _BUILT.search(text):
        return "minified"
    c = composition(text)
    plain_json = text.lstrip().startswith(("{", "[")) and c["dense"] < 4000
    if c["dense"] >= 200 and not plain_json:
        if c["space"] < 0.12 and c["short_names"] > 0.5 and c["keywords"] >= 2 and (c["mean_line"] > 80 or c["max_line"] > 300):
            return "minified"
        if c["string_share"] > 0.6 and (c["longest_string"] > 400 or c["strings"] >= 8) and c["keywords"] <= 8 and not c["logic"]:
            return "data"
        if c["number_share"] > 0.4 and c["numbers"] > 40 and c["keywords"] <= 8 and not c["logic"]:
            return "data"
        if c["number_share"] + c["string_share"] > 0.45 and c["numbers"] + c["strings"] > 2 * (c["words"] + 1) and c["keywords"] <= 8 and not c["logic"]:
            return "data"
    return None


def vendor_package(path: str | None) -> str | None:
    """'' in a folder for third-party code, the package's name in a folder of its own there, null elsewhere."""
    m = _VENDOR_DIR.search((path or "").replace("\\", "/"))
    return (m.group("package").lower() if m.group("inside") and m.group("package") else "") if m else None


def line_keys(text: str) -> list[int]:
    """Distinct signed 64-bit hashes of each line with the line after it; short lines join their neighbours."""
    lines = ["".join(x.split()) for x in text.split("\n")]
    lines = [x for x in lines if len(x) >= 6]
    keys = {xxhash.xxh64_intdigest(a + "\n" + b) for a, b in zip(lines, lines[1:]) if len(a) + len(b) >= 30}
    return [k - (1 << 64) if k >= 1 << 63 else k for k in sorted(keys)]


def profile_files(contents: DataFrame) -> DataFrame:
    """file_id, repo (hash), rule, class_id, keys of each text of `files.file_contents`."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [line_keys(c) for c in batch["content"]]
            yield pd.DataFrame({
                "file_id": batch["file_id"],
                "repository_id": batch["repository_id"],
                "rule": [rule_class(p, c) for p, c in zip(batch["path"], batch["content"])],
                "package": [vendor_package(p) for p in batch["path"]],
                "keys": keys,
            })

    rows = contents.select("file_id", "repository_id", "path", "content").mapInPandas(
        profile, "file_id string, repository_id string, rule string, package string, keys array<long>")
    return rows.select(
        "file_id", "rule", "package", F.col("package").isNotNull().alias("in_vendor_dir"), F.xxhash64(F.coalesce("repository_id", F.lit(""))).alias("repo"),
        F.when(F.size("keys") > 0, F.xxhash64("keys")).alias("class_id"), F.size("keys").alias("n_keys"), "keys")


def cross_repository_containment(profiles: DataFrame, min_containment: float = MIN_CONTAINMENT, min_shared: int = MIN_SHARED_KEYS) -> DataFrame:
    """class_id, repo, n_keys, shared, containment: the largest overlap found with one class of another repository.

    A class with files in two repositories is contained in itself for each of them.
    The overlap is exact for the class chosen by the votes; where that one is below
    `min_containment` (half of it in folders for third-party code) or `min_shared`, it
    is the largest of all classes that reach both.
    """
    members = profiles.filter(F.col("class_id").isNotNull())
    classes = cut_lineage(
        members.groupBy("class_id", "repo").agg(F.first("keys").alias("keys"), F.first("n_keys").alias("n_keys"),
            F.max("in_vendor_dir").alias("some_vendor"), F.min("in_vendor_dir").alias("all_vendor")))
    spread = classes.groupBy("class_id").agg(F.min("repo").alias("low"), F.max("repo").alias("high"))
    postings = classes.select("class_id", "repo", F.explode("keys").alias("key"))
    # the classes of the least and of the greatest repository that hold a key: all keys of a library name the same two
    index = (
        postings.groupBy("key")
        .agg(F.min(F.struct("repo", "class_id")).alias("a"), F.max(F.struct("repo", "class_id")).alias("b"))
        .filter("a.repo <> b.repo")
    )
    # every class votes, key by key, for a class outside its repository
    votes = (
        postings.join(index, "key")
        .select("class_id", "repo", F.when(F.col("a.repo") != F.col("repo"), F.col("a.class_id")).otherwise(F.col("b.class_id")).alias("other"))
        .groupBy("class_id", "repo", "other").agg(F.count("*").alias("votes"))
        .groupBy("class_id", "repo").agg(F.max(F.struct("votes", "other")).alias("v"), F.sum("votes").alias("reach"))
        .select("class_id", "repo", "v.other", "reach")
    )
    candidates = classes.join(votes, ["class_id", "repo"]).select(
        "class_id", "repo", "n_keys", "keys", "some_vendor", "all_vendor", "other", "reach")
    whole = classes.groupBy(F.col("class_id").alias("other")).agg(F.first("keys").alias("other_keys"))
    overlap = cut_lineage(candidates.join(whole, "other").select(
        "class_id", "repo", "n_keys", "some_vendor", "all_vendor", "reach", F.size(F.array_intersect("keys", "other_keys")).alias("shared")))
    # classes whose choice falls short though their keys elsewhere would do
    least, most = (
        F.greatest(F.lit(min_shared), F.ceil(F.col("n_keys") * F.when(F.col(c), min_containment / 2).otherwise(min_containment) - 1e-9))
        for c in ("some_vendor", "all_vendor"))
    short = overlap.withColumn("needed", F.when(F.col("shared") < least, least).otherwise(most)).filter(
        (F.col("shared") < most) & (F.col("reach") >= F.col("needed"))).join(spread.filter("low = high").select("class_id"), "class_id", "left_semi")
    short = cut_lineage(short.select("class_id", "repo", "needed"))
    if not short.isEmpty():
        per_class = spread.join(whole.withColumnRenamed("other", "class_id"), "class_id").select(
            F.col("class_id").alias("other"), "low", "high", F.explode("other_keys").alias("key"))
        asked = short.join(postings, ["class_id", "repo"])
        elsewhere = per_class.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
            F.count("*").alias("n_classes"), F.min("low").alias("low"), F.max("high").alias("high"))
        rarest = asked.join(elsewhere, "key").filter("low <> repo OR high <> repo").groupBy("class_id", "repo", "needed").agg(
            F.array_sort(F.collect_list(F.struct("n_classes", "key"))).alias("by_rarity"))
        looked_up = rarest.select("class_id", "repo", F.explode(
            F.slice("by_rarity", F.lit(1), F.greatest(F.lit(0), F.size("by_rarity") - F.col("needed") + 1).cast("int"))).alias("k"))
        pairs = looked_up.select("class_id", "repo", "k.key").join(per_class, "key").filter(
            "other <> class_id AND (low <> repo OR high <> repo)").select("class_id", "repo", "other").distinct()
        more = pairs.join(classes, ["class_id", "repo"]).join(whole, "other").select(
            "class_id", "repo", "n_keys", F.size(F.array_intersect("keys", "other_keys")).alias("shared"))
        overlap = overlap.select(more.columns).unionByName(more)
    copied = classes.join(spread.filter("low <> high"), "class_id").select(
        "class_id", "repo", "n_keys", F.col("n_keys").alias("shared"))
    return (
        overlap.select(copied.columns).unionByName(copied).groupBy("class_id", "repo")
        .agg(F.max("shared").alias("shared"), F.max("n_keys").alias("n_keys"))
        .select("class_id", "repo", "n_keys", "shared", (F.col("shared") / F.col("n_keys")).alias("containment"))
    )


def classify_files(contents: DataFrame, min_containment: float = MIN_CONTAINMENT, min_shared: int = MIN_SHARED_KEYS) -> DataFrame:
    """file_id, kind ('generated', 'minified', 'data', 'vendored' or null for hand-written), containment.

    The index comes first: copies across repositories are vendored; in folders for
    third-party code half the containment suffices, and there the other files of a
    package of which some repository holds a copy are vendored as well. Composition
    decides on the remaining files. Blank and null texts are hand-written. Files with
    equal ids are judged apart and given once with the first kind by name.
    """
    profiles = cut_lineage(profile_files(contents))
    contained = cross_repository_containment(profiles, min_containment, min_shared).select("class_id", "repo", "shared", "containment")
    needed = F.when(F.col("in_vendor_dir"), min_containment / 2).otherwise(min_containment)
    joined = cut_lineage(profiles.drop("keys").join(contained, ["class_id", "repo"], "left").withColumn(
        "copied", F.coalesce((F.col("containment") >= needed) & (F.col("shared") >= min_shared), F.lit(False))))
    known = joined.filter("copied AND package <> ''").select("package").distinct().withColumn("known", F.lit(True))
    judged = joined.join(known, "package", "left").withColumn("vendored", F.col("copied") | F.coalesce("known", F.lit(False)))
    return (
        judged.select("file_id", F.when(F.col("vendored"), F.lit("vendored")).otherwise(F.col("rule")).alias("kind"), "containment")
        .groupBy("file_id").agg(F.min("kind").alias("kind"), F.max("containment").alias("containment"))
    )

"""Licences of files: headers and licence files against templates, and inheritance from the nearest directory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.session import lookup, materialised

#: Short statements of common licences, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright is waived under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Whole texts, standard notices and titles, by SPDX name: what headers and licence files are compared with beside ``TEMPLATES``.
#: No title of so few words that one word on a line of its own, as the German "mit", comes near it.
TEXTS = Path(__file__).with_name("licence_texts")
GNU = {"AGPL-3.0": ("Affero General", "3"), "GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"),
       "LGPL-3.0": ("Lesser General", "3")}
GNU_NOTICE = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by "
    "the Free Software Foundation, {upto}version {version} of the License{later}. This {work} is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "{kind} Public License for more details. You should have received a copy of the GNU {kind} Public License along with this {work}. If not, {end}")
GNU_ENDS = ("see <https://www.gnu.org/licenses/>.",
            "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.")
NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
     "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
     "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007")]
for _name, _kind in {"CC-BY-4.0": "Attribution", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-SA-4.0": "Attribution-ShareAlike"}.items():
    NOTICES += [(_name, t.format(_kind)) for t in (
        "Creative Commons {} 4.0 International Public License",
        "This work is licensed under a Creative Commons {} 4.0 International License.")]
for _name, (_kind, _version) in GNU.items():
    NOTICES += [(_name, GNU_NOTICE.format(work=_work, kind=_kind, version=_version, upto=_upto, later=_later, end=_end))
                for _work in ("program", "library") for _end in GNU_ENDS
                for _upto, _later in (("either ", ", or (at your option) any later version"), ("", ""))]
#: Lines from either end of a file that are compared one by one, and the cosine from which they state a licence.
HEADER, LIKE = 3, 0.6
#: Lines of the overlapping windows of headers and licence files; each starts half a window after the one before.
WINDOWS = (2, 4, 16)
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
#: Comments at the start of a text, with what is blank between them; and its first paragraph. Possessive: no text makes them deep.
COMMENT = (r"\A(?:[\x20\t\r\n\x{FEFF}]*+(?:/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"\"\"[\s\S]*?\"\"\"|'{3}[\s\S]*?'{3}|\{-[\s\S]*?-\}|\(\*[\s\S]*?\*\)"
           r"|(?:#|//|--|;|%|(?i:rem|dnl)\x20)[^\n]*+))++")
PARAGRAPH = r"\A(?:[\x20\t\r]*+\n)*+(?:[\x20\t]*+[^\s][^\n]*+(?:\n|\z))++"
#: A stated SPDX name, without what says only which versions it allows.
SPDX, SPDX_VERSIONS = r"(?i)SPDX-License-Identifier:[\x20\t(]*+([a-z0-9][a-z0-9.+-]*+)", r"(-only|-or-later|\+)$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def directory(path: Column) -> Column:
    """The part before the last slash; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def forms() -> list[tuple[int, str, str]]:
    """``form`` (number), ``licence`` and text of all that headers and licence files are compared with."""
    whole = [(p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    return [(n, k, t) for n, (k, t) in enumerate([*TEMPLATES.items(), *NOTICES, *whole])]


def template_terms(spark: SparkSession) -> DataFrame:
    """``form``, ``licence``, ``term``, ``tf``: a table as long as the templates, whatever the files."""
    known = spark.createDataFrame(forms(), "form int, licence string, text string")
    return known.select("form", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("form", "licence", "term").agg(F.count("*").alias("tf"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row: the optimiser copies an expression to every place that names it,
    inside lambdas as well, but does not look through a variable."""
    return F.transform(F.array(value), use)[0]


def opened(text: Column) -> Column:
    """The lines of a text with a term, each with its ``terms``, whether it is read by itself (``near``: at an end or in the
    leading comment), whether it is in the header (``open``: leading comment, else first paragraph; ``comment``: the former), and
    its SPDX name (``spdx``). Where comment and paragraph end is found once for a text, so the work is proportional to its length."""
    def upto(part: Column) -> Column:
        return F.when(part == "", 0).otherwise(F.size(F.split(F.rtrim(part, F.lit("\n")), "\n")))

    def line(t: Column, at: Column, own: Column) -> Column:
        near = (at < HEADER) | (at >= own["size"] - HEADER) | (at < own["comment"])
        return F.struct(terms(t).alias("terms"), near.alias("near"), (at < own["open"]).alias("open"), (at < own["comment"]).alias("comment"),
                        F.regexp_extract(t, SPDX, 1).alias("spdx"))

    def in_order(all_lines: Column) -> Column:
        def with_comment(comment: Column) -> Column:
            first = F.when(comment == "", F.regexp_extract(text, PARAGRAPH, 0)).otherwise("")
            own = F.struct(F.size(all_lines).alias("size"), upto(comment).alias("comment"), F.greatest(upto(comment), upto(first)).alias("open"))
            return once(own, lambda o: F.transform(all_lines, lambda t, at: line(t, at, o)))

        return once(F.regexp_extract(text, COMMENT, 0), with_comment)

    return F.filter(once(F.split(text, "\n"), in_order), lambda x: F.size(x["terms"]) > 0)


def windows(lines: str, sizes: Sequence[int] = WINDOWS) -> Column:
    """Terms of the overlapping windows of the column ``lines`` (terms by line), and of all of them."""
    def of(w: int) -> Column:  # a lambda of two parameters would get the index as the second
        starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(w // 2))
        return F.transform(starts, lambda k: F.flatten(F.slice(lines, k + 1, w)))

    return F.concat(F.array(F.flatten(lines)), *[of(w) for w in sizes])


def statements(texts: DataFrame, places: DataFrame, files: int) -> DataFrame:
    """``file``, ``text`` -> ``file``, ``licence``, ``score`` of the best statement of each file that has one.

    Compared with the templates are a file's header as a whole, its overlapping windows (of a first paragraph, which is prose, only
    the longest), and the lines to be read by themselves; all lines, windows and the whole text if it is a licence file (``places``: ``file``, ``whole``). Terms weigh their count times
    ln((1 + files) / (1 + files with the term)) + 1, counted over headers, ends and licence files for the terms of the templates;
    others weigh as terms of no file, so that they count against a match. A match can only reach ``LIKE`` if it has an anchor: the
    terms left to a template without its anchors are too light. Only texts with an anchor, which one pattern tells, are cut up,
    and only what has one is taken apart. A name given with SPDX is stated as it stands. ``texts`` is read three times and never
    shuffled; the terms of texts with an anchor are written once.
    """
    spark = texts.sparkSession
    known = template_terms(spark)
    vocabulary = lookup(known.select("term").distinct(), "template-terms")

    def own(lines: Column, keep) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.filter(lines, keep), lambda x: x["terms"])))

    head = lambda x: x["near"] | x["open"]
    sets = once(opened(F.col("text")), lambda lines: F.array(*[F.struct(F.lit(is_head).alias("head"), own(lines, keep).alias("terms"))
                                                               for is_head, keep in ((True, head), (False, lambda x: ~head(x)))]))
    hits = texts.select("file", F.explode(sets).alias("s")).select("file", "s.head", F.explode("s.terms").alias("term")).join(F.broadcast(vocabulary), "term")
    hits = hits.groupBy("file", "term").agg(F.max("head").alias("head")).join(places, "file").where(F.col("head") | F.col("whole"))
    spread = vocabulary.join(hits.groupBy("term").count(), "term", "left").select("term", idf(F.coalesce("count", F.lit(0)), files).alias("idf"))
    spread = lookup(spread, "term-weights")
    found = known.join(F.broadcast(spread), "term").collect()
    norm: dict[int, float] = {}
    for r in found:
        norm[r.form] = norm.get(r.form, 0.0) + (r.tf * r.idf) ** 2
    shares = [(r.form, r.licence, r.term, r.tf * r.idf / norm[r.form] ** 0.5) for r in found]
    index = lookup(spark.createDataFrame(shares, "form int, licence string, term string, share double"), "template-index")
    marks = anchors({(form, t): w for form, _, t, w in shares}, {r.term: r.idf for r in found})
    marked = lambda words: F.arrays_overlap(words, F.array(*[F.lit(t) for t in sorted(marks)]))

    def units(head: bool, *own: Column) -> Column:
        return F.transform(F.filter(F.concat(*own), marked), lambda t: F.struct(F.lit(head).alias("head"), t.alias("terms")))

    def parts(lines: Column) -> Column:
        terms_of = lambda keep: F.transform(F.filter(lines, keep), lambda x: x["terms"])
        return F.struct(*[terms_of(keep).alias(k) for k, keep in (
            ("every", lambda x: F.lit(True)), ("near", lambda x: x["near"]), ("comment", lambda x: x["comment"]), ("first", lambda x: x["open"] & ~x["comment"]))])

    anchor = rf"(?<![a-z0-9])(?:{'|'.join(sorted(marks))})(?![a-z0-9])" if marks else "(?!)"
    some = texts.where(F.lower("text").rlike(anchor)).select("file", once(opened(F.col("text")), parts).alias("p")).select("file", "p.*")
    some = materialised(some, "texts-with-anchors")
    some = some.select("file", F.concat(units(True, F.col("near"), windows("comment"), windows("first", WINDOWS[-1:])), units(False, F.col("every"), windows("every"))).alias("units"))
    some = some.select("file", F.posexplode("units").alias("at", "unit")).join(places, "file").where(F.col("unit.head") | F.col("whole"))
    some = some.select("file", "at", F.explode("unit.terms").alias("term")).groupBy("file", "at", "term").agg(F.count("*").alias("tf"))
    some = some.join(F.broadcast(spread), "term", "left")
    some = materialised(some.select("file", "at", "term", (F.col("tf") * F.coalesce("idf", idf(F.lit(0), files))).alias("w")), "unit-terms")
    length = some.groupBy("file", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = some.join(F.broadcast(index), "term").groupBy("file", "at", "form", "licence").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    scored = dots.join(length, ["file", "at"]).select("file", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("score")).where(F.col("score") >= LIKE)
    named = texts.where(F.col("text").rlike(SPDX)).select("file", F.explode(F.filter(opened(F.col("text")), lambda x: x["spdx"] != "")).alias("x"))
    named = named.join(places, "file").where(F.col("x.near") | F.col("x.open") | F.col("whole"))
    scored = scored.unionByName(named.select("file", F.regexp_replace("x.spdx", SPDX_VERSIONS, "").alias("licence"), F.lit(1.0).alias("score")))
    # 'All rights reserved.' also stands above licences, so it counts where no other is stated
    best = F.min(F.struct((F.col("licence") == "Proprietary").alias("bare"), (-F.col("score")).alias("less"), "licence")).alias("best")
    return scored.groupBy("file").agg(best).select("file", "best.licence", (-F.col("best.less")).alias("score"))


def idf(count: Column, files: int) -> Column:
    return F.log((1.0 + files) / (1.0 + count)) + 1.0


def anchors(shares: dict[tuple[int, str], float], rare: dict[str, float]) -> set[str]:
    """Terms of each template, the rarest and then heaviest first, until the rest could not reach ``LIKE`` by themselves."""
    out: set[str] = set()
    by_form: dict[int, list[tuple[float, float, str]]] = {}
    for (form, term), share in shares.items():
        by_form.setdefault(form, []).append((rare[term], share, term))
    for own in by_form.values():
        rest = 1.0
        for _, share, term in sorted(own, reverse=True):
            if rest**0.5 < LIKE - 1e-6:
                break
            out.add(term)
            rest = max(0.0, rest - share * share)
    return out


def file_licences(files: DataFrame, paths: DataFrame | None = None, id: str = "path", text: str = "text") -> DataFrame:
    """Every file's licence: ``id``, ``path``, ``licence``, ``score``, ``found`` (header, inherited or none), ``directory``.

    A file that states a licence in its header (the leading comment, or else the first paragraph) or in its first or last
    ``HEADER`` lines has that one. Any other takes that of the nearest directory, from its own upwards, with a licence file
    (``LICENCE_FILE``) that states one anywhere in its text; ``directory`` is that directory. If a directory has several, the
    best match counts, then the first name.

    The id is the path itself, or ``paths`` has the path (``path``) of each id once. A file with a null path has no directory and inherits
    nothing; null and empty texts state nothing. Files with the same id are told apart by their texts; repeated rows have the
    same result. Texts are read where they lie: only terms, lines and windows with terms of a licence, ids and paths are shuffled. A
    directory is joined to its ancestors once, not once for each of its files.
    """
    own_id = F.col(f"`{id}`").cast("string")
    print_ = F.coalesce(F.hex(F.xxhash64(F.col(f"`{text}`").cast("string"))), F.lit("-"))
    key = F.concat(F.when(own_id.isNull(), "-").otherwise(F.concat(F.lit("+"), own_id)), F.lit("/"), print_)
    rows = files.select(F.col(f"`{id}`").alias("id"), key.alias("file"), F.col(f"`{text}`").cast("string").alias("text"))
    named = rows.select("id", "file")
    if paths is None:
        named = named.withColumn("path", F.col("id").cast("string"))
    else:
        named = named.join(paths.select(F.col(f"`{id}`").alias("id"), F.col("path").cast("string").alias("path")), "id", "left")
    named = named.withColumn("whole", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))).withColumn("directory", directory(F.col("path")))
    named = materialised(named, "paths")
    places = named.select("file", "whole").distinct()
    texts = rows.where("text is not null").select("file", "text")
    own = materialised(named.join(statements(texts, places, places.count()), "file", "left"), "own-licences")
    best = F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best")
    given = own.where("licence is not null and whole").groupBy("directory").agg(best)
    given = lookup(given.select(F.col("directory").alias("above"), F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score")), "licence-files")
    bare = own.where("licence is null and path is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    steps = F.when(F.col("directory") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    up = bare.select("directory", F.explode(steps).alias("depth")).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = up.join(given, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "licence", "score")).alias("from"))
    nearest = lookup(nearest, "inherited")
    return own.join(nearest, "directory", "left").select(
        "id", "path", *[F.coalesce(F.col(c), F.col(f"from.{c}")).alias(c) for c in ("licence", "score")],
        F.when(F.col("licence").isNotNull(), "header").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(F.col("licence").isNull(), F.col("from.above")).alias("directory"))

"""Licence scans: an exact containment join between text blocks and licence templates."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch, let, text_of

#: The ASCII letters lower-casing touches, the word pattern, the base phrases and the notices to find.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "All rights reserved"),
)
#: Paragraphs and whole texts of licences, for documents that copy them without a notice.
BODIES = (
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
)
#: Tokens that tell licences apart: a block must hold those of its template.
NAMES = ("mit", "apache", "gnu", "mozilla", "creative", "commons")
THETA = 0.8
STRIDE = 32  # the least; a template's blocks are two strides, and it is no longer than one, so it lies whole in one of them

_BASE = "struct<n_base:long,first_word:long,last_word:long,base_labels:array<string>>"
_MATCH = "struct<label:string,block:int,containment:double>"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_tokens(text: str) -> list[str]:
    return sorted(set(template_words(text)))


def stride_of(text: str) -> int:
    """The least power of two, from STRIDE on, that the template's words don't exceed."""
    return max(STRIDE, 1 << (len(template_words(text)) - 1).bit_length())


def _literal(tokens: list[str]) -> Column:
    return F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")


def token_order(docs: DataFrame, text_col: str = "text", templates=TEMPLATES + BODIES) -> list[str]:
    """The templates' tokens, rarest first by the number of texts in all of docs that hold them.

    Collects one row a template token, a bound that doesn't grow with docs.
    """
    vocabulary = sorted({t for _, text in templates for t in template_tokens(text)})
    held = docs.select(F.explode(F.array_intersect(words(lowered(text_of(text_col))), _literal(vocabulary))).alias("token"))
    count = {r.token: r.n for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (count.get(t, 0), t))


@dataclass
class Index:
    """The templates in the global order: their sets, and an inverted index of their prefixes."""

    order: list[str]
    #: (template, label, tokens, need, names)
    sets: list[tuple[int, str, list[str], int, list[str]]]
    #: (token, stride, template, place, size, need, prefix)
    posts: list[tuple[str, int, int, int, int, int, list[str]]]

    @staticmethod
    def of(order: list[str], templates, theta: float) -> Index:
        rank, sets, posts = {t: i for i, t in enumerate(order)}, [], []
        for k, (label, text) in enumerate(templates):
            tokens = sorted(template_tokens(text), key=rank.__getitem__)
            need = math.ceil(theta * len(tokens) - 1e-9)
            prefix = tokens[: len(tokens) - need + 1]
            sets.append((k, label, tokens, need, [t for t in tokens if t in NAMES]))
            posts += [(t, stride_of(text), k, i, len(tokens), need, prefix) for i, t in enumerate(prefix)]
        return Index(order, sets, posts)


def live_blocks(w: Column, index: Index) -> Column:
    """array<struct<stride, at, tokens>> of the word array w: the blocks that hold a token of some template's prefix, with
    those of their tokens that templates have, in the global order."""
    strides = sorted({p[1] for p in index.posts})
    keys = {s: _literal(sorted({p[0] for p in index.posts if p[1] == s})) for s in strides}
    none = F.array().cast("array<struct<stride:int,at:int,tokens:array<string>>>")

    def of(ws: Column, stride: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ws) - 1 - stride), F.lit(stride))
        live = F.filter(starts, lambda i: F.arrays_overlap(F.slice(ws, i + 1, 2 * stride), keys[stride]))
        return F.transform(live, lambda i: F.struct(F.lit(stride).alias("stride"), i.alias("at"), F.array_intersect(_literal(index.order), F.slice(ws, i + 1, 2 * stride)).alias("tokens")))

    every = _literal(sorted({p[0] for p in index.posts}))
    return F.when(F.arrays_overlap(w, every), F.concat(none, *(of(w, s) for s in strides))).otherwise(none) if strides else none


def block_matches(rows: DataFrame, index: Index) -> DataFrame:
    """(row, matches) from rows (row, blocks): every block and template at containment theta or more.

    A join by prefix tokens.  With all sets in the global order, a block that holds need = ceil(theta |T|) of T's tokens has
    one of T's first |T| - need + 1 tokens among its own first |B| - need + 1 (prefix filter), has need tokens of the
    vocabulary (length filter), and from the first token in common, neither side has fewer than need tokens left (positional
    filter).  A pair is taken at the first token the prefixes have in common, so it comes once.  Only then are the sets
    intersected.  A block must also hold T's NAMES.  Both broadcast tables are as large as the templates given.
    """
    spark = rows.sparkSession
    posts = spark.createDataFrame(index.posts, "token string, stride int, template int, place int, n int, need int, prefix array<string>")
    sets = spark.createDataFrame(index.sets, "template int, label string, of array<string>, least int, named array<string>")
    block = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.stride", "b.at", "b.tokens", F.posexplode("b.tokens").alias("i", "token"))
    left = F.least(F.size("tokens") - F.col("i"), F.col("n") - F.col("place"))
    first = F.size(F.array_intersect(F.slice("tokens", 1, F.col("i")), F.col("prefix"))) == 0
    near = block.join(F.broadcast(posts), ["token", "stride"]).where((F.size("tokens") >= F.col("need")) & (F.col("i") <= F.size("tokens") - F.col("need")) & (left >= F.col("need")) & first)
    both = F.size(F.array_intersect("tokens", "of"))
    hit = near.join(F.broadcast(sets), "template").where((both >= F.col("least")) & (F.size(F.array_except("named", "tokens")) == 0))
    found = hit.select("row", F.struct("label", F.col("at").alias("block"), (both / F.size("of")).alias("containment")).alias("match"))
    return found.groupBy("row").agg(F.sort_array(F.collect_list("match")).alias("matches"))


def base_places(w: Column) -> Column:
    """struct<n_base, first_word, last_word, base_labels> of the word array w."""
    phrase = rf"(?<= )(?:{'|'.join(PHRASES)})(?= )"
    spaced = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

    def placed(s: Column) -> Column:
        return let(F.split(s, phrase, -1), lambda p: counted(s, p))

    def counted(s: Column, p: Column) -> Column:
        found = F.regexp_extract_all(s, F.lit(phrase), F.lit(0))
        gaps = lambda x: F.size(F.split(x, " ")) - 2  # noqa: E731  words of a piece that begins and ends with a space
        last = F.size(w) - gaps(F.element_at(p, -1)) - F.size(F.split(F.element_at(found, -1), " "))
        labels = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.coalesce(*(F.when(x == k, v) for k, v in PHRASES.items())))))
        return F.struct(F.size(found).cast("long").alias("n_base"), gaps(F.element_at(p, 1)).cast("long").alias("first_word"), last.cast("long").alias("last_word"), labels.alias("base_labels"))

    none = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base_labels"))
    return F.when(F.array_contains(w, "license"), let(spaced, lambda s: F.when(s.rlike(phrase), placed(s)).otherwise(none))).otherwise(none).cast(_BASE)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + BODIES, theta: float = THETA) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels array, matches array, labels array.

    Base: the places where a phrase's words stand consecutively.  Method: an exact containment join of text blocks and
    templates, see block_matches; a template's blocks are two strides long and begin at each stride, the stride being no
    shorter than the template; tokens are ordered by their frequency over all of docs.

    Defined results: null and empty texts have no words, places or labels; an empty table gives no rows; repeated rows get
    the same answer each; without templates only base labels are given; other columns aren't read.
    """
    work = Scratch(docs.sparkSession, "licenses")
    index = Index.of(token_order(docs, text_col, templates), templates, theta)
    one = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), base_places(w).alias("base"), live_blocks(w, index).alias("blocks"))
    rows = docs.select(F.col(id_col).alias("id"), let(words(lowered(text_of(text_col))), one).alias("x"))
    rows = work.table(rows.select("id", "x.n_words", "x.base.*", "x.blocks", F.monotonically_increasing_id().alias("row")), "rows")
    none = F.array().cast(f"array<{_MATCH}>")
    found = rows.drop("blocks").join(block_matches(rows.where(F.size("blocks") > 0).select("row", "blocks"), index), "row", "left").withColumn("matches", F.coalesce("matches", none))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    return work.result(found.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "matches", labels.alias("labels")))


def score(n_base: Column, matches: Column) -> Column:
    """1 where a base phrase stands, else the best containment, else 0."""
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))
    return F.when(n_base > 0, F.lit(1.0)).otherwise(best)

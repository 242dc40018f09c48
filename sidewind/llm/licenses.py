"""License scan by ordered signature rules. Native: DataFrame functions only.

Texts become lower-cased words with single spaces. Each rule is a regular expression over those
words with a label, a priority and a weight, gated by a keyword: the longest text that every match of
the rule holds, taken from the expression itself. A rule's expression only runs on texts with its
keyword, so few of the rules, which come as one table of patterns, are compiled for a text. (As literal
patterns they make a plan that takes ten seconds to compile, and run no faster.)
The matches become rows of their own; a match is suppressed if its interval lies within
that of a match of better priority, or within a longer one of the same priority. What survives gives the labels, spans and score.

The contract's base phrases are found beside the rules, by place, in the same words.

Size: detections are keyed by row and bounded by a text's length; windows over them sort and spill.
Nothing is grouped by text or license, so no popular license makes a hot group.

Defined results: null text is the empty text, with no words, null places, empty label strings and
score 0; equal intervals of equal priority both stay; repeated rows each give a row; an empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, materialize

#: The base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label, keyword, names (regular expressions over single-spaced words), identifier tags, addresses.
LICENSES = [
    ("mit", "mit", ["mit", "mit x11", "expat"], ["mit"], ["opensource org licenses mit"]),
    ("mit-0", "mit", ["mit no attribution", "mit 0"], ["mit 0"], ["opensource org licenses mit 0"]),
    ("apache-2", "apache", ["apache(?: software)? (?:license )?(?:version |v)?2(?: 0)?", "apache license version 2(?: 0)?"], ["apache 2 0"], ["apache org licenses license 2 0"]),
    ("apache-1.1", "apache", ["apache(?: software)? (?:license )?(?:version |v)?1 1"], ["apache 1 1"], ["apache org licenses license 1 1"]),
    ("apache-1", "apache", ["apache(?: software)? (?:license )?(?:version |v)?1 0"], ["apache 1 0"], ["apache org licenses license 1 0"]),
    ("gpl-3", "general public", ["gnu general public license (?:version |v)?3(?: 0)?", "gpl ?(?:version |v)?3"], ["gpl 3 0(?: only| or later)?"], ["gnu org licenses gpl 3 0"]),
    ("gpl-2", "general public", ["gnu general public license (?:version |v)?2(?: 0)?", "gpl ?(?:version |v)?2"], ["gpl 2 0(?: only| or later)?"], ["gnu org licenses gpl 2 0"]),
    ("gpl-1", "general public", ["gnu general public license (?:version |v)?1(?: 0)?"], ["gpl 1 0(?: only| or later)?"], ["gnu org licenses gpl 1 0"]),
    ("lgpl-3", "lesser", ["gnu lesser general public license (?:version |v)?3(?: 0)?", "lgpl ?(?:version |v)?3"], ["lgpl 3 0(?: only| or later)?"], ["gnu org licenses lgpl 3 0"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license (?:version |v)?2 1", "lgpl ?(?:version |v)?2 1"], ["lgpl 2 1(?: only| or later)?"], ["gnu org licenses lgpl 2 1"]),
    ("lgpl-2", "library", ["gnu library general public license (?:version |v)?2(?: 0)?"], ["lgpl 2 0(?: only| or later)?"], ["gnu org licenses old licenses lgpl 2 0"]),
    ("agpl-3", "affero", ["gnu affero general public license (?:version |v)?3(?: 0)?", "agpl ?(?:version |v)?3"], ["agpl 3 0(?: only| or later)?"], ["gnu org licenses agpl 3 0"]),
    ("fdl-1.3", "free documentation", ["gnu free documentation license (?:version |v)?1 3"], ["gfdl 1 3(?: only| or later)?"], ["gnu org licenses fdl 1 3"]),
    ("fdl-1.2", "free documentation", ["gnu free documentation license (?:version |v)?1 2"], ["gfdl 1 2(?: only| or later)?"], ["gnu org licenses fdl 1 2"]),
    ("bsd-2", "bsd", ["(?:2|two) clause bsd", "simplified bsd", "freebsd"], ["bsd 2 clause"], ["opensource org licenses bsd 2 clause"]),
    ("bsd-3", "bsd", ["(?:3|three) clause bsd", "(?:new|modified|revised) bsd"], ["bsd 3 clause"], ["opensource org licenses bsd 3 clause"]),
    ("bsd-4", "bsd", ["(?:4|four) clause bsd", "original bsd"], ["bsd 4 clause"], ["spdx org licenses bsd 4 clause"]),
    ("0bsd", "bsd", ["zero clause bsd", "0bsd"], ["0bsd"], ["opensource org licenses 0bsd"]),
    ("isc", "isc", ["isc"], ["isc"], ["opensource org licenses isc"]),
    ("mpl-2", "mozilla", ["mozilla public license (?:version |v)?2(?: 0)?", "mpl 2(?: 0)?"], ["mpl 2 0"], ["mozilla org mpl 2 0"]),
    ("mpl-1.1", "mozilla", ["mozilla public license (?:version |v)?1 1", "mpl 1 1"], ["mpl 1 1"], ["mozilla org mpl 1 1"]),
    ("epl-2", "eclipse", ["eclipse public license (?:version |v)?2(?: 0)?", "epl 2(?: 0)?"], ["epl 2 0"], ["eclipse org legal epl 2 0", "eclipse org legal epl v20"]),
    ("epl-1", "eclipse", ["eclipse public license (?:version |v)?1(?: 0)?", "epl 1(?: 0)?"], ["epl 1 0"], ["eclipse org legal epl v10"]),
    ("cddl-1", "cddl", ["cddl (?:version |v)?1(?: 0)?", "common development and distribution license cddl"], ["cddl 1 0"], ["opensource org licenses cddl 1 0"]),
    ("eupl-1.2", "european union", ["european union public licen[cs]e (?:version |v)?1 2"], ["eupl 1 2"], ["joinup ec europa eu collection eupl"]),
    ("artistic-2", "artistic", ["artistic license (?:version |v)?2(?: 0)?"], ["artistic 2 0"], ["opensource org licenses artistic 2 0"]),
    ("artistic-1", "artistic", ["artistic license (?:version |v)?1(?: 0)?"], ["artistic 1 0"], ["opensource org licenses artistic 1 0"]),
    ("bsl-1", "boost", ["boost software license(?: (?:version |v)?1(?: 0)?)?"], ["bsl 1 0"], ["boost org license 1 0"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"], ["zlib"], ["opensource org licenses zlib"]),
    ("unlicense", "unlicense", ["unlicense"], ["unlicense"], ["unlicense org"]),
    ("wtfpl", "wtfpl", ["wtfpl"], ["wtfpl"], ["wtfpl net"]),
    ("python-2", "python", ["python software foundation", "psf"], ["psf 2 0", "python 2 0"], ["docs python org 3 license"]),
    ("ruby", "ruby", ["ruby"], ["ruby"], ["ruby lang org en about license"]),
    ("php-3", "php", ["php license (?:version |v)?3(?: 01?)?"], ["php 3 01?"], ["php net license 3 01"]),
    ("openssl", "openssl", ["openssl"], ["openssl"], ["openssl org source license"]),
    ("postgresql", "postgresql", ["postgresql"], ["postgresql"], ["opensource org licenses postgresql"]),
    ("ms-pl", "microsoft", ["microsoft public license", "ms pl"], ["ms pl"], ["opensource org licenses ms pl"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license", "ms rl"], ["ms rl"], ["opensource org licenses ms rl"]),
    ("cpal-1", "common public", ["common public attribution license(?: (?:version |v)?1(?: 0)?)?"], ["cpal 1 0"], ["opensource org licenses cpal 1 0"]),
    ("cpl-1", "common public", ["common public license(?: (?:version |v)?1(?: 0)?)?"], ["cpl 1 0"], ["opensource org licenses cpl1 0"]),
    ("osl-3", "open software", ["open software license(?: (?:version |v)?3(?: 0)?)?"], ["osl 3 0"], ["opensource org licenses osl 3 0"]),
    ("afl-3", "academic free", ["academic free license(?: (?:version |v)?3(?: 0)?)?"], ["afl 3 0"], ["opensource org licenses afl 3 0"]),
    ("ofl-1.1", "sil", ["sil open font license(?: (?:version |v)?1 1)?"], ["ofl 1 1"], ["scripts sil org ofl", "openfontlicense org"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source", "ncsa"], ["ncsa"], ["opensource org licenses ncsa"]),
    ("upl-1", "universal permissive", ["universal permissive license(?: (?:version |v)?1(?: 0)?)?"], ["upl 1 0"], ["opensource org licenses upl"]),
    ("vim", "vim", ["vim"], ["vim"], ["vimhelp org uganda"]),
    ("sspl-1", "server side", ["server side public license(?: (?:version |v)?1(?: 0)?)?"], ["sspl 1 0"], ["mongodb com licensing server side public license"]),
    ("busl-1.1", "business source", ["business source license(?: (?:version |v)?1 1)?"], ["busl 1 1"], ["mariadb com bsl11"]),
    ("elastic-2", "elastic", ["elastic license(?: (?:version |v)?2(?: 0)?)?"], ["elastic 2 0"], ["elastic co licensing elastic license"]),
    ("cc0", "cc0", ["cc0(?: 1 0)?", "creative commons zero(?: v?1 0)?"], ["cc0 1 0"], ["creativecommons org publicdomain zero"]),
    ("cc-by-nc-nd", " nc nd", ["cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv\\w+"], ["cc by nc nd [1-4] [05]"], ["creativecommons org licenses by nc nd"]),
    ("cc-by-nc-sa", " nc sa", ["cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike"], ["cc by nc sa [1-4] [05]"], ["creativecommons org licenses by nc sa"]),
    ("cc-by-nc", " by nc", ["cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial"], ["cc by nc [1-4] [05]"], ["creativecommons org licenses by nc"]),
    ("cc-by-nd", " by nd", ["cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv\\w+"], ["cc by nd [1-4] [05]"], ["creativecommons org licenses by nd"]),
    ("cc-by-sa", " by sa", ["cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike"], ["cc by sa [1-4] [05]"], ["creativecommons org licenses by sa"]),
    ("cc-by", " by ", ["cc by(?: [1-4] [05])?", "creative commons attribution"], ["cc by [1-4] [05]"], ["creativecommons org licenses by"]),
    ("odbl-1", "open database", ["open (?:data commons )?open database license(?: v?1 0)?", "odc odbl", "open database license"], ["odbl 1 0"], ["opendatacommons org licenses odbl"]),
    ("odc-by", "open data commons", ["open data commons attribution"], ["odc by 1 0"], ["opendatacommons org licenses by"]),
    ("pddl-1", "public domain", ["public domain dedication and license"], ["pddl 1 0"], ["opendatacommons org licenses pddl"]),
    ("llama-community", "llama", ["llama [234](?: [0-9])? community"], ["llama[23]"], ["llama com license"]),
    ("openrail", "openrail", ["(?:creativeml )?openrail(?: m)?", "bigscience openrail m"], ["openrail"], ["bigscience huggingface co blog the bigscience rail license"]),
]
#: Families whose version is not named, and notices without a license: label, keyword, expression, priority, weight.
GENERAL = [
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", 4, 0.6),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", 3, 0.65),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", 3, 0.65),
    ("gpl", " gpl", "under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl", 4, 0.6),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", 4, 0.6),
    ("apache", "apache", "apache(?: software)? licen[cs]e", 4, 0.6),
    ("mozilla", "mozilla", "mozilla public licen[cs]e", 4, 0.6),
    ("creative-commons", "creative commons", "creative commons(?: licen[cs]e)?", 4, 0.5),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|in to|into|to) the public domain", 3, 0.8),
    ("proprietary", "all rights reserved", "all rights reserved", 4, 0.3),
    ("proprietary", "proprietary", "proprietary and confidential", 4, 0.5),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 2, 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee", 2, 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 2, 0.95),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 5, 0.2),
]
#: How a grant begins, and what may stand between that and the name.
VERBS = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|governed|shared|made available|redistributed) (?:by|under|with|subject to) "
GRANT = VERBS + r"(?:(?:an?|the) )?(?:terms (?:and conditions )?of )?(?:(?:an?|the) )?"


def keyword(expr: str) -> str:
    """The longest text that each match of an expression holds, with the spaces around a match."""
    left, group = f" {expr} ", re.compile(r"\(\?[:=]([^()]*)\)(\??)")
    while group.search(left):
        left = group.sub(lambda m: "\n" if m[2] or "|" in m[1] else m[1], left)
    return max(re.split(r"\n|\[[^]]*\]\??|\\\w[+*]?|.\?", left), key=len)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression, priority, weight), best priority first."""
    out = []
    for label, _, names, tags, urls in LICENSES:
        out += [(label, rf"spdx license identifier (?:{t})", 1, 1.0) for t in tags]
        out += [(label, u, 1, 0.95) for u in urls]
        for n in names:
            out.append((label, GRANT + f"(?:{n})(?= )(?: licen[cs]e)?(?: (?:version |v)?[0-9](?: [0-9])?)?", 2, 0.95))
            out.append((label, f"(?:{n}) licen[cs]e" if "licen" not in n else f"(?:{n})", 3, 0.85))
    out += [(label, e, p, v) for label, _, e, p, v in GENERAL]
    return [(a, keyword(e.removeprefix(GRANT)), e, p, v) for a, e, p, v in sorted(dict.fromkeys(out), key=lambda r: (r[2], r[0], r[1]))]


def keywords() -> dict[str, list[str]]:
    """The rules' keywords: those of grants, those in a match with "licen", and others."""
    out: dict[str, set[str]] = {"grant": set(), "licen": set(), "": set()}
    for _, key, expr, *_ in rules():
        out["grant" if expr.startswith(GRANT) else "licen" if "licen" in keyword(expr) or "licen[cs]e" in re.sub(r"\(\?:[^()]*\)\?", "", expr) else ""].add(key)
    return {k: sorted(v) for k, v in out.items()}


def words_of(text: Column) -> Column:
    """The words, each after a space, and a closing space; one space if there are none."""
    low = lower_ascii(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, " ")


def spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[tuple[str, str]] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one row per row.

    detections: array of (label, start, end, priority, weight), places in characters of the words joined by spaces.
    """
    w = F.col("w")
    table = rules()
    none = F.array().cast("array<string>")
    can = {"grant": w.rlike(f" {VERBS}"), "licen": w.contains("licen"), "": F.lit(True)}
    found = F.array_distinct(F.concat(*[F.when(can[k], F.filter(F.array(*map(F.lit, v)), lambda x: w.contains(x))).otherwise(none) for k, v in keywords().items()]))
    rule_array = F.from_json(F.lit(_json(table)), "array<struct<label:string,key:string,expr:string,priority:int,weight:double>>")
    # A match takes its first space but not its last, so matches can stand next to each other.
    hits = F.transform(
        F.filter(rule_array, lambda r: F.array_contains(F.col("found"), r.key) & F.regexp_like(w, r.expr)),
        lambda r: F.struct(
            r.label.alias("label"), r.priority.alias("priority"), r.weight.alias("weight"),
            F.transform(F.split(w, r.expr, -1), lambda x: F.length(x)).alias("gaps"),
            F.transform(F.regexp_extract_all(w, r.expr, F.lit(0)), lambda x: F.length(x)).alias("sizes"),
        ),
    )
    none = F.lit(None).cast("array<struct<label:string,priority:int,weight:double,gaps:array<int>,sizes:array<int>>>")

    n, first, last, here = F.lit(0).cast("long"), [], [], []
    for phrase, label in base:
        there = w.contains(f" {phrase} ")
        at = F.instr(w, f" {phrase} ")
        n = n + F.when(there, F.regexp_count(w, F.lit(f" {phrase}(?= )")).cast("long")).otherwise(0)
        first.append(F.when(there, spaces(F.substring(w, F.lit(1), at - 1))))
        back = F.instr(F.reverse(w), f" {phrase[::-1]} ")
        rest = F.reverse(F.substring(F.reverse(w), F.lit(1), back - 1))
        last.append(F.when(there, F.col("n_words") - len(phrase.split(" ")) - spaces(rest)))
        here.append(F.when(there, F.lit(label)))
    scanned = (
        docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
        .select("doc_id", "w", (spaces(w) - 1).alias("n_words"), found.alias("found"))
        .select(
            "doc_id", "n_words", F.monotonically_increasing_id().alias("row"), n.alias("n_base"),
            F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_compact(F.array(*here)).alias("base_labels"),
            F.when(F.size("found") > 0, hits).otherwise(none).alias("hits"),
        )
    )
    scanned = materialize(scanned, "scanned")
    # Places: the running sum of gaps and matches of one rule in one row.
    by_rule = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        scanned.where(F.size("hits") > 0)
        .select("row", F.posexplode("hits").alias("rule", "hit"))
        .select("row", "rule", "hit.label", "hit.priority", "hit.weight", F.posexplode(F.arrays_zip(F.slice("hit.gaps", F.lit(1), F.size("hit.sizes")).alias("gap"), F.col("hit.sizes").alias("size"))).alias("k", "piece"))
        .withColumn("end", F.sum(F.col("piece.gap") + F.col("piece.size")).over(by_rule))
        .select("row", "label", "priority", "weight", (F.col("end") - F.col("piece.size")).alias("start"), "end")
    )
    order = Window.partitionBy("row").orderBy(F.col("start") * (1 << 32) - F.col("end"))
    within = F.lit(False)
    for level in sorted({r[3] for r in table}):
        ends = F.max(F.when(F.col("priority") == level, F.col("end")))
        same = ends.over(order.rangeBetween(Window.unboundedPreceding, 0)) >= F.col("end")
        wider = ends.over(order.rangeBetween(Window.unboundedPreceding, -1)) >= F.col("end")
        within = within | F.coalesce(F.when(F.col("priority") > level, same).when(F.col("priority") == level, wider), F.lit(False))
    kept = pieces.withColumn("within", within).where("NOT within").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "priority", "weight"))).alias("detections")
    )
    out = scanned.drop("hits").join(kept, "row", "left")
    labels = F.array_union("base_labels", F.transform(F.coalesce("detections", F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int,weight:double>>")), lambda d: d.label))
    score = F.greatest(F.when(F.col("n_base") > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d.weight)), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"), score.alias("score"), "detections",
    )


def _json(table: list[tuple]) -> str:
    return json.dumps([{"label": a, "key": k, "expr": f" (?:{e})(?= )", "priority": p, "weight": v} for a, k, e, p, v in table])

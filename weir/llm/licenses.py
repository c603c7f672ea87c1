"""License scans by ordered signature rules.

Native: DataFrame functions only. Text becomes lower-case words with single spaces. A rule is a
keyword, a regular expression, a label and a priority; its expression runs only on texts that
contain the keyword, and no rule at all on texts without any licensing word. Of overlapping
detections those inside a larger one go; of others that overlap the lower priority goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licences as (label, keyword that gates the rules, expression of the name in
# lower-case words, expression of the short identifier in lower-case words).
LICENSES = (
    ("gpl-1.0", "general public license", "gnu general public license(?: gpl)? (?:version |v)1(?: 0)?", "gpl 1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "general public license", "gnu general public license(?: gpl)? (?:version |v)2(?: 0)?", "gpl(?: v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "general public license", "gnu general public license(?: gpl)? (?:version |v)3(?: 0)?", "gpl(?: v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "library general public license", "gnu library general public license(?: version 2(?: 0)?)?", "lgpl(?: v)? ?2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general public license", "gnu lesser general public license(?: lgpl)? (?:version |v)2 1", "lgpl(?: v)? ?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general public license", "gnu lesser general public license(?: lgpl)? (?:version |v)3(?: 0)?", "lgpl(?: v)? ?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "affero general public license", "gnu affero general public license(?: (?:version |v)3(?: 0)?)?", "agpl(?: v)? ?3(?: 0)?(?: only| or later)?"),
    ("gfdl", "free documentation license", "gnu free documentation license(?: version 1 [123])?", "gfdl(?: 1 [123])?"),
    ("apache-1.0", "apache", "apache (?:software )?license (?:version )?1 0", "apache 1 0"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:version )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?license (?:version |v )?2(?: 0)?", "apache 2(?: 0)?"),
    ("mit", "mit license", "(?:the )?(?:x11 )?mit license(?: mit)?", "mit"),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?", "mit 0"),
    ("bsd-0", "zero clause", "(?:bsd )?zero clause (?:bsd )?license", "0bsd"),
    ("bsd-2", "license", "(?:bsd 2|2|two) clause (?:bsd )?(?:simplified )?license|simplified bsd license|freebsd license", "bsd 2 clause"),
    ("bsd-3", "license", "(?:bsd 3|3|three) clause (?:bsd )?license|(?:new|modified|revised) bsd license", "bsd 3 clause"),
    ("bsd-4", "license", "(?:bsd 4|4|four) clause (?:bsd )?license|original bsd license", "bsd 4 clause"),
    ("isc", "isc license", "(?:the )?isc license", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    ("mpl-1.0", "mozilla public license", "mozilla public license (?:version |v )?1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla public license", "mozilla public license (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public license", "mozilla public license (?:version |v )?2 0", "mpl 2 0"),
    ("epl-1.0", "eclipse public license", "eclipse public license (?:version |v )?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse public license", "eclipse public license (?:version |v )?2 0", "epl 2 0"),
    ("cddl", "common development and distribution license", "common development and distribution license(?: (?:version )?1 [01])?", "cddl 1 [01]"),
    ("cpl-1.0", "common public license", "common public license(?: (?:version )?1 0)?", "cpl 1 0"),
    ("ipl-1.0", "ibm public license", "ibm public license(?: (?:version )?1 0)?", "ipl 1 0"),
    ("eupl", "european union public licen", "european union public licen[cs]e(?: (?:version |v )?1 [012])?", "eupl 1 [012]"),
    ("artistic-1.0", "artistic license", "artistic license 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic license", "artistic license 2 0", "artistic 2 0"),
    ("python", "license", "python software foundation license|psf license(?: agreement)?", "python 2 0|psf 2 0"),
    ("ruby", "ruby license", "(?:the )?ruby license", "ruby"),
    ("php", "php license", "(?:the )?php license(?: (?:version )?3 01?)?", "php 3 01?"),
    ("perl", "same terms as perl", "same terms as perl(?: itself)?", "perl"),
    ("boost", "boost software license", "boost software license(?: version 1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "do what the", "do what the fuck you want to public license", "wtfpl"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("public-domain", "public domain", "(?:dedicated to|placed in|released into) the public domain", "public domain"),
    ("cc-by-1.0", "creative commons", "creative commons attribution 1 0(?: generic)?", "cc by 1 0"),
    ("cc-by-2.0", "creative commons", "creative commons attribution 2 [05](?: generic)?", "cc by 2 [05]"),
    ("cc-by-3.0", "creative commons", "creative commons attribution 3 0(?: unported)?", "cc by 3 0"),
    ("cc-by-4.0", "creative commons", "creative commons attribution 4 0(?: international)?", "cc by 4 0"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by nc nd(?: [1-4] [05])?"),
    ("odbl", "database license", "open (?:data commons )?(?:open )?database license", "odbl(?: 1 0)?"),
    ("ogl-uk", "open government licen", "open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?", "ogl uk(?: [123] 0)?"),
    ("ofl-1.1", "open font license", "sil open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("openssl", "openssl", "openssl(?: toolkit)? license", "openssl"),
    ("ms-pl", "microsoft public license", "microsoft public license(?: ms pl)?", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal license(?: ms rl)?", "ms rl"),
    ("apsl", "apple public source license", "apple public source license(?: (?:version )?[12] [012])?", "apsl [12] [012]"),
    ("afl", "academic free license", "academic free license(?: (?:version |v )?[123] [012])?", "afl [123] [012]"),
    ("osl", "open software license", "open software license(?: (?:version |v )?[123] [01])?", "osl [123] [01]"),
    ("qpl", "q public license", "q public license(?: (?:version )?1 0)?", "qpl 1 0"),
    ("zpl", "zope public license", "zope public license(?: (?:version )?[12] [01])?", "zpl [12] [01]"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?(?:document )?license", "w3c"),
    ("vim", "vim license", "(?:the )?vim license", "vim"),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", "postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", "ncsa"),
    ("sleepycat", "sleepycat", "sleepycat (?:software )?(?:public )?license", "sleepycat"),
    ("curl", "curl license", "(?:the )?curl license", "curl"),
    ("beerware", "ware license", "(?:the )?beer ?ware license", "beerware"),
    ("bsl-1.1", "business source license", "business source license(?: (?:version )?1 1)?", "busl 1 1"),
    ("sspl", "server side public license", "server side public license(?: (?:version )?1(?: 0)?)?", "sspl 1 0"),
    ("elastic", "elastic license", "elastic license(?: (?:version )?2(?: 0)?)?", "elastic 2 0"),
)

# What stands around a licence's name, and the priority of such a detection.
TEMPLATES = (
    (90, "spdx license identifier (?:{id})"),
    (80, "(?:licensed|released|distributed|available|made available|provided|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})"),
    (60, "(?:{name})"),
)

# Sentences of licence texts, and notices. Label, keyword, expression, priority.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software", 95),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 95),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted", 85),
    ("bsd-3", "neither the name", "neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors", 90),
    ("zlib", "this software is provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors", 90),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 95),
    ("gpl-or-later", "or at your option any later version", "either version [123] of the license or at your option any later version", 75),
    ("gpl", "free software you can redistribute", "this program is free software you can redistribute it and or modify it", 70),
    ("apache-2.0", "may not use this file except", "you may not use this file except in compliance with the license", 70),
    ("mpl-2.0", "subject to the terms of the mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 95),
    ("cc-by", "creative commons", "creative commons attribution(?: license)?", 50),
    ("gpl", "general public license", "gnu general public license", 50),
    ("lgpl", "lesser general public license", "gnu lesser general public license", 55),
    ("apache", "apache license", "apache license", 50),
    ("cc-by", "cc by", "cc by", 40),
    ("bsd", "bsd ", "bsd (?:style )?license", 50),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 30),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 60),
    ("warranty-disclaimer", "without warrant", "without warrant(?:y|ies)(?: or conditions)? of any kind", 20),
    ("copyright-notice", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 10),
)

#: Without one of these a text has no detection.
GATES = ("licen", "copyright", "public domain", "creative commons", "cc by", "cc0", "spdx", "rights reserved", "permission", "redistribut", "warrant", "proprietary", "terms as perl", "neither the name", "unencumbered", "provided as is", "you may not use", "attribution")


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, expression, priority) in order. Expressions match whole words."""
    out = list(SENTENCES)
    for label, keyword, name, short in LICENSES:
        for priority, template in TEMPLATES:
            gate = "spdx license identifier" if "{id}" in template else keyword
            out.append((label, gate, template.format(name=name, id=short), priority))
    return [(label, keyword, f"(?<= )(?:{x})(?= )", p) for label, keyword, x, p in out]


def words_of(text: Column) -> Column:
    """The words in order with single spaces between and around; one space if there are none.

    lower() also maps letters beyond A-Z; what it makes of them are word characters as before,
    so the words' number and the base phrases are the same as with A-Z alone.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _count(c: Column) -> Column:
    """Words in a stretch of words_of(): spaces are between words only."""
    t = F.trim(c)
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections: kept (start, stop, priority, label), by characters of the normalised words.
    score is the highest kept priority over 100, 0 without detection and base phrase. Null and
    empty texts have no words. Equal rows give equal rows. Everything is computed inside a row:
    no shuffle, nothing collected.
    """
    d = docs.select(F.col("doc_id"), words_of(F.col("text")).alias("w"))
    pattern = "(?<= )(?:" + "|".join(PHRASES) + ")(?= )"
    has_phrase = F.contains("w", F.lit(" gnu general public license ")) | F.contains("w", F.lit(" apache license ")) | F.contains("w", F.lit(" cc by ")) | F.contains("w", F.lit(" mit license "))
    none = F.array().cast("array<string>")
    d = d.select(
        "doc_id", "w", _count(F.col("w")).alias("n_words"),
        F.when(has_phrase, F.regexp_extract_all("w", F.lit(pattern), F.lit(0))).otherwise(none).alias("places"),
        F.when(has_phrase, F.split("w", pattern, -1)).otherwise(none).alias("between"),
    )
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("w", F.lit(g))
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(p).alias("p")) for label, k, x, p in rules()])
    hit = "array<struct<start:int,stop:int,p:int,label:string>>"

    def places(r: Column) -> Column:
        """A rule's detections with offsets: what lies between them adds up to their starts."""
        found, parts = F.regexp_extract_all("w", r["x"], F.lit(0)), F.split("w", r["x"], -1)
        step = lambda acc, z: F.struct(
            (acc["at"] + F.length(z["0"]) + F.length(F.coalesce(z["1"], F.lit("")))).cast("int").alias("at"),
            F.when(z["1"].isNull(), acc["hits"]).otherwise(F.concat(acc["hits"], F.array(F.struct(
                (acc["at"] + F.length(z["0"])).cast("int").alias("start"), (acc["at"] + F.length(z["0"]) + F.length(z["1"])).cast("int").alias("stop"), r["p"].alias("p"), r["label"].alias("label"))))).alias("hits"),
        )
        both = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.get(parts, i).alias("0"), F.get(found, i).alias("1")))
        return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(hit).alias("hits")), step, lambda acc: acc["hits"])

    hits = F.flatten(F.transform(F.filter(table, lambda r: F.contains("w", r["k"])), places))
    # by start, the longer first, then the higher priority; one pass keeps or drops against the last kept
    keyed = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["stop"]).alias("back"), (-h["p"]).alias("low"), h["label"].alias("label"))))

    def resolve(kept: Column, h: Column) -> Column:
        last = F.element_at(kept, -1)
        one = F.array(F.struct(h["start"].alias("start"), (-h["back"]).alias("stop"), (-h["low"]).alias("p"), h["label"].alias("label")))
        return (
            F.when(F.size(kept) == 0, one)
            .when(-h["back"] <= last["stop"], kept)  # inside
            .when(h["start"] >= last["stop"], F.concat(kept, one))
            .when(-h["low"] > last["p"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), one))
            .otherwise(kept)
        )

    kept = F.when(gate, F.aggregate(keyed, F.array().cast(hit), resolve)).otherwise(F.array().cast(hit))
    d = d.withColumn("detections", kept)
    base = F.array_distinct(F.transform("places", lambda p: F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[p]))
    n, last = F.size("places"), F.element_at("places", -1)
    best = F.coalesce(F.array_max(F.transform("detections", lambda h: h["p"])), F.lit(0))
    return d.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"),
        F.when(n > 0, _count(F.get("between", F.lit(0)))).alias("first_word"),
        F.when(n > 0, F.col("n_words") - _count(F.element_at("between", -1)) - _count(last)).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("detections", lambda h: h["label"]))), ",").alias("labels"),
        (F.greatest(best, F.when(n > 0, 50).otherwise(0)) / 100.0).cast("double").alias("score"), "detections",
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

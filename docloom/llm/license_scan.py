"""License scan: ordered signature rules, a keyword prefilter, and suppression of overlapped detections.

Native: DataFrame functions only. The text is reduced to its words (A-Z folded, words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with one space around each; a rule is a regular expression over
that form, so a detection is an interval of words. A rule is run only on texts that hold its keyword; a few
stems, one of which every detection holds, are looked for first. Where detections overlap, one whose interval lies inside another's
is dropped if the other's rule has at least its priority; of equal intervals the higher priority, then
the earlier rule, stays.

Base phrases (``BASE``) are counted at all their places and always keep their labels.

``score``: 1 - product of (1 - confidence) over the labels found by surviving detections, a label's
confidence being that of its best rule; 0 without any.

Defined results: null text is empty and has no words; null first_word and last_word where no base
phrase stands; label lists are empty strings where nothing is found; repeated rows are rows of their
own; an empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe_text, stored

#: Phrase and label, in order.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


class Rule(NamedTuple):
    label: str
    priority: int  # 3 text of the license, 2 name with version or grant, 1 bare name
    keyword: str  # begins a word of every text that the pattern matches
    pattern: str  # over words joined by one space
    confidence: float


def _rules() -> tuple[Rule, ...]:
    out: list[Rule] = []

    def add(label: str, priority: int, keyword: str, pattern: str, confidence: float) -> None:
        out.append(Rule(label, priority, keyword, pattern, confidence))

    split: list[tuple[str, str, str]] = []
    # Names: label, keyword, pattern of the name.
    names = (
        ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:v ?|version )?2(?: 0)?"),
        ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:v ?|version )?3(?: 0)?"),
        ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:v ?|version )?2 1"),
        ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?(?:v ?|version )?3(?: 0)?"),
        ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?(?:v ?|version )?3(?: 0)?"),
        ("gpl-2.0", "general", r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v ?|version )2(?: 0)?"),
        ("gpl-3.0", "general", r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v ?|version )3(?: 0)?"),
        ("lgpl-2.1", "lesser", r"gnu lesser general public license (?:v ?|version )2 1"),
        ("lgpl-3.0", "lesser", r"gnu lesser general public license (?:v ?|version )3(?: 0)?"),
        ("lgpl", "lesser", r"gnu lesser general public license"),
        ("lgpl-2.0", "library", r"gnu library general public license(?: (?:v ?|version )?2(?: 0)?)?"),
        ("agpl-3.0", "affero", r"gnu affero general public license(?: (?:v ?|version )?3(?: 0)?)?"),
        ("gfdl", "documentation", r"gnu free documentation license(?: (?:v ?|version )?1(?: [0-3])?)?"),
        ("apache-2.0", "apache", r"apache(?: software)? license (?:v ?|version )?2(?: 0)?"),
        ("apache-1.1", "apache", r"apache(?: software)? license (?:v ?|version )?1 1"),
        ("apache-1.0", "apache", r"apache(?: software)? license (?:v ?|version )?1 0"),
        ("mit", "mit", r"(?:the )?mit license"),
        ("mit-0", "mit", r"mit no attribution(?: license)?"),
        ("x11", "x11", r"x11 license"),
        ("isc", "isc", r"isc license"),
        ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: 2 clause)? license"),
        ("bsd-2-clause", "bsd", r"bsd 2 clause(?: simplified| freebsd)?(?: license)?"),
        ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: 3 clause)? license"),
        ("bsd-3-clause", "bsd", r"bsd 3 clause(?: new| revised| modified)?(?: license)?"),
        ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd license"),
        ("0bsd", "bsd", r"(?:zero clause bsd|0 bsd|bsd zero clause)(?: license)?"),
        ("0bsd", "0bsd", r"0bsd(?: license)?"),
        ("bsd", "bsd", r"bsd (?:style )?license"),
        ("mpl-1.1", "mozilla", r"mozilla public license (?:v ?|version )?1 1"),
        ("mpl-2.0", "mozilla", r"mozilla public license (?:v ?|version )?2(?: 0)?"),
        ("mpl", "mozilla", r"mozilla public license"),
        ("epl-1.0", "eclipse", r"eclipse public license (?:v ?|version )?1(?: 0)?"),
        ("epl-2.0", "eclipse", r"eclipse public license (?:v ?|version )?2(?: 0)?"),
        ("epl", "eclipse", r"eclipse public license"),
        ("edl-1.0", "eclipse", r"eclipse distribution license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("cddl-1.0", "common", r"common development and distribution license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("cpl-1.0", "common", r"common public license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("ipl-1.0", "ibm", r"ibm public license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("cecill-2.1", "cecill", r"cecill(?: free software license)?(?: agreement)?(?: (?:v ?|version )?2(?: 1)?)?"),
        ("artistic-1.0", "artistic", r"artistic license (?:v ?|version )?1(?: 0)?"),
        ("artistic-2.0", "artistic", r"artistic license (?:v ?|version )?2(?: 0)?"),
        ("artistic", "artistic", r"(?:the )?artistic license"),
        ("zlib", "zlib", r"zlib(?: libpng)? license"),
        ("libpng", "libpng", r"libpng license"),
        ("unlicense", "unlicense", r"(?:the )?unlicense"),
        ("wtfpl", "wtfpl", r"wtfpl(?: (?:v ?|version )?2)?"),
        ("bsl-1.0", "boost", r"boost software license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("busl-1.1", "business", r"business source license(?: (?:v ?|version )?1 1)?"),
        ("sspl-1.0", "server", r"server side public license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("elastic-2.0", "elastic", r"elastic license(?: (?:v ?|version )?2(?: 0)?)?"),
        ("eupl-1.1", "european", r"european union public (?:license|licence) (?:v ?|version )?1 1"),
        ("eupl-1.2", "european", r"european union public (?:license|licence)(?: (?:v ?|version )?1 2)?"),
        ("ms-pl", "microsoft", r"microsoft public license"),
        ("ms-rl", "microsoft", r"microsoft reciprocal license"),
        ("osl-3.0", "open", r"open software license(?: (?:v ?|version )?3(?: 0)?)?"),
        ("afl-3.0", "academic", r"academic free license(?: (?:v ?|version )?3(?: 0)?)?"),
        ("ecl-2.0", "educational", r"educational community license(?: (?:v ?|version )?2(?: 0)?)?"),
        ("ncsa", "illinois", r"university of illinois ncsa open source license"),
        ("psf-2.0", "python", r"python software foundation license(?: (?:v ?|version )?2)?"),
        ("python-2.0", "python", r"python license(?: (?:v ?|version )?2(?: 0)?)?"),
        ("php-3.01", "php", r"php license(?: (?:v ?|version )?3(?: 0?1)?)?"),
        ("ruby", "ruby", r"ruby license"),
        ("openssl", "openssl", r"openssl(?: ssleay)? license"),
        ("postgresql", "postgresql", r"postgresql (?:license|licence)"),
        ("vim", "vim", r"vim license"),
        ("w3c", "w3c", r"w3c software(?: notice)?(?: and)? license"),
        ("ofl-1.1", "sil", r"sil open font license(?: (?:v ?|version )?1 1)?"),
        ("odbl-1.0", "database", r"open (?:data commons open )?database license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("odc-by-1.0", "commons", r"open data commons attribution license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("pddl-1.0", "public", r"(?:open data commons )?public domain dedication(?: and)? license"),
        ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
        ("cc0-1.0", "creative", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
        ("public-domain", "domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
        ("blueoak-1.0.0", "oak", r"blue oak model license(?: 1 0 0)?"),
        ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software license)(?: (?:v ?|version )?2)?"),
        ("upl-1.0", "universal", r"universal permissive license(?: (?:v ?|version )?1(?: 0)?)?"),
        ("openrail", "rail", r"(?:creative ml |bigscience |bigcode )?open rail(?: m)?(?: license)?"),
        ("openrail", "openrail", r"(?:creative ml |bigscience |bigcode )?openrail(?: m)?(?: license)?"),
    )
    # A name whose version may be left out says the version only if it stands there.
    for label, keyword, name in names:
        whole = re.fullmatch(r"(.*)\(\?:( \(\?:v \?\|version \)\?.*)\)\?", name)
        if whole and re.search(r"-\d", label):
            split += [(label, keyword, whole[1] + whole[2]), (re.sub(r"-\d.*", "", label), keyword, whole[1])]
        else:
            split.append((label, keyword, name))
    for label, keyword, name in split:
        add(label, 1, keyword, name, 0.7)
    # The same names in a grant or a notice say more than a mention.
    for label, keyword, name in split:
        add(label, 2, keyword, rf"(?:licensed|released|distributed|available|provided|published|redistributed|used) (?:to you )?(?:only )?(?:under|according to|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 0.95)
    # SPDX tags: the identifier as it reads once reduced to words.
    tags = (
        "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "apache-1.1", "apache-2.0", "mit", "mit-0", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cddl-1.0", "cddl-1.1",
        "cpl-1.0", "artistic-1.0", "artistic-2.0", "zlib", "libpng", "unlicense", "wtfpl", "bsl-1.0", "busl-1.1", "sspl-1.0", "eupl-1.1", "eupl-1.2", "ms-pl", "ms-rl", "osl-3.0", "afl-3.0", "ecl-2.0", "ncsa", "psf-2.0", "python-2.0", "postgresql",
        "vim", "w3c", "ofl-1.1", "odbl-1.0", "odc-by-1.0", "pddl-1.0", "cc0-1.0", "cc-by-3.0", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "blueoak-1.0.0", "upl-1.0", "x11",
    )
    for tag in tags:
        words = tag.replace("-", " ").replace(".", " ")
        add(tag, 3, "spdx", rf"spdx license identifier {words}(?: only| or later)?", 1.0)
    # Creative Commons: clauses, in short and in words.
    for clauses, spelled in (
        ("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:s|atives|ative works)"),
        ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
    ):
        for version in ("1", "2", "2 5", "3", "4"):
            number = version.replace(" ", ".") if " " in version else f"{version}.0"
            tail = version if " " in version else f"{version} 0"
            add(f"cc-{clauses.replace(' ', '-')}-{number}", 2, "cc", rf"cc {clauses} {tail}", 0.95)
            add(f"cc-{clauses.replace(' ', '-')}-{number}", 3, "creative", rf"creative commons {spelled} (?:version )?{tail}(?: international| unported| generic)?(?: public)?(?: license| licence)?", 1.0)
        add(f"cc-{clauses.replace(' ', '-')}", 1, "creative", rf"creative commons {spelled}(?: license| licence)?", 0.8)
        if clauses != "by":  # the bare phrase is a base phrase
            add(f"cc-{clauses.replace(' ', '-')}", 1, "cc", rf"cc {clauses}", 0.7)
    # Sentences of the license texts themselves.
    for label, keyword, pattern in (
        ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("mit", "merge", r"rights to use copy modify merge publish distribute sublicense and or sell copies"),
        ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
        ("apache-2.0", "basis", r"distributed on an as is basis without warranties or conditions of any kind"),
        ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser |library |affero )?general public license"),
        ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |library |affero )?general public license"),
        ("gpl", "received", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
        ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
        ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
        ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
        ("mpl-2.0", "source", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
        ("zlib", "altered", r"altered source versions must be plainly marked as such"),
        ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
        ("bsl-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
        ("wtfpl", "fuck", r"you just do what the fuck you want to"),
        ("ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
        ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
        ("cc-by", "creative", r"this work is licensed under a creative commons attribution"),
        ("gpl-2.0", "version", r"either version 2 of the license or at your option any later version"),
        ("gpl-3.0", "version", r"either version 3 of the license or at your option any later version"),
        ("lgpl-2.1", "version", r"either version 2 1 of the license or at your option any later version"),
        ("gpl-2.0", "activities", r"activities other than copying distribution and modification are not covered by this license"),
        ("gpl", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
        ("gpl-3.0", "propagate", r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement"),
        ("gpl", "everyone", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
        ("wtfpl", "everyone", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
        ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
        ("apache-2.0", "patent", r"patent license to make have made use offer to sell sell import and otherwise transfer the work"),
        ("apache-2.0", "governing", r"see the license for the specific language governing permissions and limitations under the license"),
        ("apache-2.0", "recipients", r"you must give any other recipients of the work or derivative works a copy of this license"),
        ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("isc", "provided", r"provided that the above copyright notice and this permission notice appear in all copies"),
        ("hpnd", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
        ("hpnd", "publicity", r"in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
        ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
        ("mpl-1.1", "contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
        ("mpl-1.1", "governing", r"see the license for the specific language governing rights and limitations under the license"),
        ("epl", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license"),
        ("epl-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
        ("epl-1.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v1 0|v 1 0|version 1 0)"),
        ("cpl-1.0", "accompanying", r"the accompanying program is provided under the terms of this common public license"),
        ("cddl-1.0", "contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
        ("zlib", "freely", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
        ("bsl-1.0", "statement", r"the copyright notices in the software and this entire statement including the above license grant"),
        ("busl-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
        ("sspl-1.0", "service", r"you must make the service source code available via network download to everyone at no charge under the terms of this license"),
        ("ms-pl", "governs", r"this license governs use of the accompanying software if you use the software you accept this license"),
        ("eupl", "eupl", r"licensed under the eupl"),
        ("psf-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
        ("postgresql", "agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
        ("w3c", "royalty", r"permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
        ("ofl-1.1", "fonts", r"the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
        ("ofl-1.1", "font", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
        ("odbl-1.0", "database", r"this (?:database|dataset|data) is made available under the open database license"),
        ("cc-by-4.0", "licensed", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license"),
        ("cc-by-sa", "creative", r"this work is licensed under (?:a|the) creative commons attribution share ?alike"),
        ("cc-by-nc", "creative", r"this work is licensed under (?:a|the) creative commons attribution non ?commercial"),
        ("cc-by-nd", "creative", r"this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:s|atives|ative works)"),
        ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        ("gfdl", "entitled", r"a copy of the license is included in the section entitled gnu free documentation license"),
        ("upl-1.0", "condition", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
        ("mulan-psl-2.0", "mulan", r"you can use this software according to the terms and conditions of the mulan psl"),
        ("cecill", "cecill", r"this software is governed by the cecill (?:b |c )?license under french law and abiding by the rules of distribution of free software"),
        ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
        ("beerware", "beer", r"the beer ?ware license"),
        ("ruby", "ruby", r"ruby is copyrighted free software by yukihiro matsumoto you can redistribute it and or modify it"),
        ("perl", "perl", r"(?:library|program|module|software) is free software you can redistribute it and or modify it under the same terms as perl itself"),
        ("tcl", "authors", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
        ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation"),
        ("json", "evil", r"the software shall be used for good not evil"),
        ("proprietary", "sold", r"(?:this|the) software is licensed not sold"),
        ("proprietary", "reproduced", r"may be reproduced (?:in any form )?without (?:the )?prior written permission"),
        ("proprietary", "reserved", r"all rights reserved"),
        ("proprietary", "unauthorized", r"unauthorized copying of this file (?:via any medium )?is strictly prohibited"),
        ("proprietary", "confidential", r"proprietary and confidential"),
    ):
        add(label, 3, keyword, pattern, 1.0 if label != "proprietary" else 0.4)
    return tuple(out)


RULES = _rules()


#: Character sequences of which every detection holds one; the rest of the rules' keywords are added below.
_STEMS = ("licen", "gpl", "spdx", " cc ", "creative commons", "bsd", "permission", "redistribut", "attribution")
_OPTIONAL = re.compile(r"\(\?:[^()]*\)\??|\[[^]]*\]\??|.\?")


def stems(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """Texts without any of these hold no detection: a stem stands in the mandatory part of its rules, else their keyword is one."""
    out = list(_STEMS)
    for r in rules:
        sure = f" {_OPTIONAL.sub('|', r.pattern)} "
        if not any(x in sure or x in r.keyword for x in out):
            out.append(r.keyword)
    return tuple(out)


def folded(text: Column) -> Column:
    """A-Z folded. Other letters are too, which no pattern or count can tell, but the two whose folded form holds a-z are changed first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def with_words(texts: DataFrame) -> DataFrame:
    """(doc_id, words): the words of a text, each with one space on either side; a single space if there are none.

    Two projections, so that the text is folded and split once.
    """
    bare = texts.select("doc_id", F.trim(F.regexp_replace(folded(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("bare"))
    return bare.select("doc_id", F.when(F.col("bare") == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), "bare", F.lit(" "))).alias("words"))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _base(words: Column, phrase: str) -> Column:
    """places, first and last word of a phrase, which cannot overlap itself; null if it stands nowhere."""
    seek = f" {phrase} "
    places = F.size(F.split(words, f" (?={phrase} )")) - 1
    first = _spaces(F.substring(words, F.lit(1), F.instr(words, seek))) - 1
    start = F.length(words) - F.instr(F.reverse(words), seek[::-1]) - len(seek) + 2
    last = _spaces(F.substring(words, F.lit(1), start)) - 1
    return F.when(F.contains(words, F.lit(seek)), F.struct(places.alias("places"), first.alias("first"), last.alias("last")))


def _text(x: str) -> str:
    """A string as a SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(words: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, i, gap, size): the i-th hit of a rule has ``size`` words, ``gap`` after the hit before it."""
    groups: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(f" {r.keyword}", []).append(f"named_struct('rule', {i}, 'pattern', {_text(f' (?:{r.pattern})(?= )')})")
    # One expression of constants, as text: a column for each of them would take seconds to build.
    table = F.expr(f"array({', '.join(f'named_struct({_text("keyword")}, {_text(k)}, {_text("rules")}, array({", ".join(v)}))' for k, v in groups.items())})")

    def found(r: Column) -> Column:
        hits = F.regexp_extract_all(words, r["pattern"], F.lit(0))
        pieces = F.split(words, r["pattern"], -1)
        return F.transform(F.arrays_zip(hits.alias("hit"), pieces.alias("piece")), lambda z, i: F.struct(r["rule"].alias("rule"), i.alias("i"), _spaces(z["piece"]).alias("gap"), _spaces(z["hit"]).alias("size")))

    held = F.flatten(F.transform(F.filter(table, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    hits = F.filter(F.flatten(F.transform(held, found)), lambda h: h["size"].isNotNull())
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,size:int>>")
    return F.when(reduce(Column.__or__, [F.contains(words, F.lit(x)) for x in stems(rules)]), hits).otherwise(none)


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    words = F.col("words")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text"))
    held = with_words(texts)
    cols = [_base(words, phrase).alias(f"b{i}") for i, (phrase, _) in enumerate(BASE)]
    found = held.select("doc_id", (_spaces(words) - 1).cast("long").alias("n_words"), *cols, _hits(words, rules).alias("hits"), "words")
    return found.withColumn("key", F.when(F.size("hits") > 0, F.sha2(words, 256))).drop("words")


def _detections(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, first, end, rule, priority, label, confidence) of every detection; key stands for a text."""
    facts = F.expr(f"array({', '.join(f'named_struct({_text("priority")}, {r.priority}, {_text("label")}, {_text(r.label)}, {_text("confidence")}, {float(r.confidence)!r}D)' for r in rules)})")
    flat = scanned.where("key is not null").select("key", "hits").dropDuplicates(["key"]).select("key", F.explode("hits").alias("h")).select("key", "h.*")
    upto = Window.partitionBy("key", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    placed = flat.withColumn("end", end).withColumn("first", F.col("end") - F.col("size"))
    return placed.select("key", "first", "end", "rule", F.element_at(facts, F.col("rule") + 1).alias("f")).select("key", "first", "end", "rule", "f.*")


def surviving(found: DataFrame) -> DataFrame:
    """The detections that no other suppresses.

    In the order of first word, longest first, an interval lies inside an earlier one exactly if the
    largest end before it reaches its own; that maximum is kept for each priority and above.
    """
    order = Window.partitionBy("key").orderBy("first", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in (1, 2, 3)]
    mine = F.when(F.col("priority") == 1, reach[0]).when(F.col("priority") == 2, reach[1]).otherwise(reach[2])
    return found.withColumn("reach", mine).where("reach is null or reach < end").drop("reach")


def detections(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, label, rule, first and end word of every surviving detection."""
    scanned = stored(_scanned(docs, rules), "scanned")
    return scanned.select("doc_id", "key").join(surviving(_detections(scanned, rules)), "key").select("doc_id", "label", "rule", "priority", "confidence", "first", "end")


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    scanned = stored(_scanned(docs, rules), "scanned")
    best = surviving(_detections(scanned, rules)).groupBy("key", "label").agg(F.max("confidence").alias("confidence"))
    # Stored, so that the join deals both sides anew and a text that very many rows share can be split;
    # rows without a detection stay out of it.
    per = stored(best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("label", "confidence"))).alias("found")), "found")
    rows = scanned.drop("hits")
    out = rows.where("key is not null").join(per, "key", "left").unionByName(rows.where("key is null").withColumn("found", F.lit(None).cast(per.schema["found"].dataType)))
    bases = [F.col(f"b{i}") for i in range(len(BASE))]
    stand = F.filter(F.array(*[F.when(b.isNotNull(), F.lit(label)) for b, (_, label) in zip(bases, BASE, strict=True)]), lambda x: x.isNotNull())
    own = F.coalesce(F.col("found.label"), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    miss = F.aggregate(F.coalesce(F.col("found.confidence"), F.array().cast("array<double>")), F.lit(1.0), lambda a, c: a * (F.lit(1.0) - c))
    n_base = sum((F.coalesce(b["places"], F.lit(0)) for b in bases), F.lit(0))
    return out.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.least(*[b["first"] for b in bases]).cast("long").alias("first_word"), F.greatest(*[b["last"] for b in bases]).cast("long").alias("last_word"),
        joined(stand).alias("base_labels"), joined(F.concat(stand, own)).alias("labels"), (F.lit(1.0) - miss).alias("score"),
    )

"""Utilities on values: conversion, IRIs, Turtle values, prefixes, language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T

#: ISO 639-1 codes and their ISO 639-3 codes.
_LANGUAGES = """
    aa aar, ab abk, ae ave, af afr, ak aka, am amh, an arg, ar ara, as asm, av ava, ay aym, az aze, ba bak, be bel, bg bul, bi bis, bm bam, bn ben, bo bod, br bre,
    bs bos, ca cat, ce che, ch cha, co cos, cr cre, cs ces, cu chu, cv chv, cy cym, da dan, de deu, dv div, dz dzo, ee ewe, el ell, en eng, eo epo, es spa, et est,
    eu eus, fa fas, ff ful, fi fin, fj fij, fo fao, fr fra, fy fry, ga gle, gd gla, gl glg, gn grn, gu guj, gv glv, ha hau, he heb, hi hin, ho hmo, hr hrv, ht hat,
    hu hun, hy hye, hz her, ia ina, id ind, ie ile, ig ibo, ii iii, ik ipk, io ido, is isl, it ita, iu iku, ja jpn, jv jav, ka kat, kg kon, ki kik, kj kua, kk kaz,
    kl kal, km khm, kn kan, ko kor, kr kau, ks kas, ku kur, kv kom, kw cor, ky kir, la lat, lb ltz, lg lug, li lim, ln lin, lo lao, lt lit, lu lub, lv lav, mg mlg,
    mh mah, mi mri, mk mkd, ml mal, mn mon, mr mar, ms msa, mt mlt, my mya, na nau, nb nob, nd nde, ne nep, ng ndo, nl nld, nn nno, no nor, nr nbl, nv nav, ny nya,
    oc oci, oj oji, om orm, or ori, os oss, pa pan, pi pli, pl pol, ps pus, pt por, qu que, rm roh, rn run, ro ron, ru rus, rw kin, sa san, sc srd, sd snd, se sme,
    sg sag, sh hbs, si sin, sk slk, sl slv, sm smo, sn sna, so som, sq sqi, sr srp, ss ssw, st sot, su sun, sv swe, sw swa, ta tam, te tel, tg tgk, th tha, ti tir,
    tk tuk, tl tgl, tn tsn, to ton, tr tur, ts tso, tt tat, tw twi, ty tah, ug uig, uk ukr, ur urd, uz uzb, ve ven, vi vie, vo vol, wa wln, wo wol, xh xho, yi yid,
    yo yor, za zha, zh zho, zu zul
"""
LANGUAGES = dict(pair.split() for pair in _LANGUAGES.split(","))
LANGUAGE_BASE = "http://lexvo.org/id/iso639-3/"


def convert(t: Column, kind: str, default: Column | None = None) -> Column:
    """A term as a Spark type; what can't be converted is an error, or the default where one is given."""
    text = T.lexical_form(t)
    if kind in ("timestamp", "date"):
        out = text.try_cast(kind)
    elif kind == "boolean":
        out = F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)
    elif kind == "string":
        out = F.coalesce(text, F.concat(F.lit("_:"), F.substring(t, 2, 1 << 20)))
    else:
        out = text.try_cast(kind)
    if default is not None:
        return F.coalesce(out, default)
    failed = t.isNotNull() & out.isNull()
    return F.when(failed, F.raise_error(F.concat(F.lit(f"cannot convert to {kind}: "), t)).cast(kind)).otherwise(out)


def normalize_values(array: Column) -> Column:
    """An array of arrays as one array without nulls and duplicates; null gives an empty one."""
    return F.coalesce(F.array_distinct(F.filter(F.flatten(F.filter(array, lambda a: a.isNotNull())), lambda x: x.isNotNull())), F.array().cast("array<string>"))


def is_valid_iri(text: Column) -> Column:
    """Absolute, of legal characters, with whole percent escapes."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?:[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;= -퟿豈-￯]|%[0-9A-Fa-f]{2})*$"), F.lit(False))


def clean_iri(text: Column) -> Column:
    """Illegal characters as percent escapes of their UTF-8 bytes, whole escapes kept; relative IRIs give null.

    Characters are escaped one by one by Spark's own expressions: no Python is involved.
    """

    def char(c: Column) -> Column:
        escaped = F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
        return F.when(c.rlike(r"^[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]$"), c).otherwise(escaped)

    body = F.array_join(F.transform(F.split(F.regexp_replace(F.trim(text), r"%(?![0-9A-Fa-f]{2})", "%25"), ""), char), "")
    clean = F.when(text.rlike(r"^[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=]*$"), text).otherwise(body)
    return F.when(F.trim(text).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), clean)


def print_value(t: Column, prefixes: dict[str, str] | None = None) -> Column:
    """A term in Turtle: qualified names where a prefix fits, quotes and escapes for literals."""
    lex, mark = T.lexical_form(t), T.tag(t)
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        lex = F.replace(lex, F.lit(plain), F.lit(code))
    uri = T.lexical_form(t)
    named = F.concat(F.lit("<"), uri, F.lit(">"))
    for prefix, space in sorted((prefixes or {}).items(), key=lambda x: len(x[1])):
        local = uri.substr(F.lit(len(space) + 1), F.length(uri))
        named = F.when(uri.startswith(space) & local.rlike(r"^[A-Za-z_][\w-]*$"), F.concat(F.lit(prefix + ":"), local)).otherwise(named)
    tail = F.when(mark == "", "").when(mark.startswith("@"), mark).otherwise(F.concat(F.lit("^^<"), mark, F.lit(">")))
    return F.when(T.is_uri(t), named).when(T.is_bnode(t), F.concat(F.lit("_:"), F.substring(t, 2, 1 << 20))).otherwise(F.concat(F.lit('"'), lex, F.lit('"'), tail))


_LITERAL = r'(?s)^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]{2}(?:-[A-Za-z0-9]+)?)|\^\^(?:<([^>]*)>|([A-Za-z][\w-]*):([\w-]+)))?$'


def parse_value(text: Column, prefixes: dict[str, str] | None = None) -> Column:
    """The term of a Turtle value; null where it is none."""
    known = F.create_map(*[F.lit(x) for pair in {"xsd": T.XSD, **(prefixes or {})}.items() for x in pair])
    part = lambda i: F.regexp_extract(text, _LITERAL, i)
    lex = part(1)
    for code, plain in (("\\\\", "\x02"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\x02", "\\")):
        lex = F.replace(lex, F.lit(code), F.lit(plain))
    dt = F.when(part(3) != "", part(3)).when(part(4) != "", F.concat(F.try_element_at(known, part(4)), part(5))).otherwise("")
    mark = F.when(part(2) != "", F.concat(F.lit("@"), F.lower(part(2)))).when(dt == T.XSD + "string", "").otherwise(dt)
    name = r"^([A-Za-z][\w-]*):([\w-]*)$"
    return (
        F.when(text.rlike(r"^<[^<>]*>$"), F.concat(F.lit("U"), F.regexp_extract(text, "^<(.*)>$", 1)))
        .when(text.startswith("_:"), F.concat(F.lit("B"), F.substring(text, 3, 1 << 20)))
        .when(text.rlike(_LITERAL), F.concat(F.lit("L"), mark, F.lit(T.SEP), lex))
        .when(text.rlike(name), F.concat(F.lit("U"), F.try_element_at(known, F.regexp_extract(text, name, 1)), F.regexp_extract(text, name, 2)))
    )


def prefix_of(uri: Column, prefixes: dict[str, str]) -> Column:
    """The prefix of the longest namespace that an IRI starts with; null without one."""
    out = F.lit(None).cast("string")
    for prefix, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(uri.startswith(space), prefix).otherwise(out)
    return out


def language_uri(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.concat(F.lit(LANGUAGE_BASE), F.try_element_at(known, F.lower(F.substring_index(code, "-", 1))))


def language_code(uri: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (v, k)])
    return F.when(uri.startswith(LANGUAGE_BASE), F.try_element_at(known, uri.substr(F.lit(len(LANGUAGE_BASE) + 1), F.length(uri))))

"""Nested bibliographic entries as flat tables that keep parent and position.

Two deliveries are understood: ``typed`` entries, whose lists are Parquet
arrays, and ``raw`` ones, whose entry is JSON text of varying shape.  Both come
to one canonical nested form; ``flatten`` then emits four tables.  It is done by
higher-order SQL only: nested ``transform`` calls attach the ancestors' keys and
indices, ``flatten`` joins the inner arrays, and one ``inline`` per target table
emits its rows, so no table needs a join or a shuffle of its own.

Defined results:

* an entry delivered several times counts at its latest ``harvested_at``; a null
  time is earlier than any other; rows of the same time are told apart by a hash
  of their content, so the choice does not depend on the partitioning;
* text that is not valid JSON, and null text, give nothing;
* null lists and empty lists give no child rows; null elements give none but
  keep their position; a lone object counts as a list of one;
* an id listed twice counts at its first position; a null id matches nothing;
* columns other than those named here are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUTHOR = "array<struct<seq:string,name:string,afids:array<string>>>"
AFFILIATION = "array<struct<afid:string,name:string,city:string,country:string>>"
CANONICAL = ["entry_id", "eid", "title", "creator", "declared_authors", "author", "affiliation", "harvested_at"]


def canonical_typed(entries: DataFrame) -> DataFrame:
    """Entries with typed lists in canonical form, repeated deliveries included."""
    author = F.expr(
        f"""cast(transform(author, a -> if(a is null, null, named_struct(
            'seq', a.`@seq`, 'name', a.authname,
            'afids', transform(a.afid, x -> x.`$`)))) as {AUTHOR})"""
    )
    affiliation = F.expr(
        f"""cast(transform(affiliation, f -> if(f is null, null, named_struct(
            'afid', f.afid, 'name', f.affilname, 'city', f.`affiliation-city`,
            'country', f.`affiliation-country`))) as {AFFILIATION})"""
    )
    return entries.select(
        F.col("entry_id").cast("bigint").alias("entry_id"),
        F.col("eid"),
        F.col("`dc:title`").alias("title"),
        F.col("`dc:creator`").alias("creator"),
        F.expr("try_cast(`author-count`.`@total` as int)").alias("declared_authors"),
        author.alias("author"),
        affiliation.alias("affiliation"),
        F.col("harvested_at"),
    )


def _listed(value: str) -> str:
    """SQL: a variant as a list, a lone value as a list of one, JSON null and absence as no list."""
    return (
        f"case when {value} is null or is_variant_null({value}) then null "
        f"else coalesce(try_variant_get({value}, '$', 'array<variant>'), array({value})) end"
    )


def _text(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'string')"


def canonical_raw(entries: DataFrame) -> DataFrame:
    """Entries as JSON text in canonical form, repeated deliveries included.

    The entry may be the whole object, stand under ``entry`` or under
    ``search-results.entry``, alone or in a list, whose first object counts.
    Author counts may be a number, a text or an object with ``@total``;
    an ``afid`` may be a text, an object with ``$``, or a list of both.
    """
    # The parser stops after the first value; text that goes on after an object or list is not valid JSON.
    whole = entries.filter(F.col("payload").rlike(r"^\s*(\{[\s\S]*\}|\[[\s\S]*\])\s*$"))
    parsed = whole.select("entry_id", "harvested_at", F.expr("try_parse_json(payload)").alias("v")).filter("v is not null")
    under = """coalesce(try_variant_get(v, '$["search-results"].entry', 'variant'),
                        try_variant_get(v, '$.entry', 'variant'), v)"""
    first = parsed.select("entry_id", "harvested_at", F.expr(under).alias("v")).select(
        "entry_id",
        "harvested_at",
        F.expr(f"try_element_at(filter({_listed('v')}, x -> x is not null and not is_variant_null(x)), 1)").alias("e"),
    )
    lists = first.filter("e is not null").select(
        F.col("entry_id").cast("bigint").alias("entry_id"),
        F.expr(_text("e", "$.eid")).alias("eid"),
        F.expr(_text("e", '$["dc:title"]')).alias("title"),
        F.expr(_text("e", '$["dc:creator"]')).alias("creator"),
        F.expr(
            """try_cast(coalesce(try_variant_get(e, '$["author-count"]["@total"]', 'string'),
                                 try_variant_get(e, '$["author-count"]', 'string')) as int)"""
        ).alias("declared_authors"),
        F.expr("try_variant_get(e, '$.author', 'variant')").alias("a"),
        F.expr("try_variant_get(e, '$.affiliation', 'variant')").alias("f"),
        "harvested_at",
    )
    afid = "try_variant_get(a, '$.afid', 'variant')"
    one_afid = f"coalesce({_text('x', '$["$"]')}, {_text('x', '$')})"
    author = f"""cast(transform({_listed("a")}, a -> if(a is null or is_variant_null(a), null, named_struct(
        'seq', {_text("a", '$["@seq"]')}, 'name', {_text("a", "$.authname")},
        'afids', transform({_listed(afid)}, x -> {one_afid})))) as {AUTHOR})"""
    affiliation = f"""cast(transform({_listed("f")}, f -> if(f is null or is_variant_null(f), null, named_struct(
        'afid', coalesce({_text("f", '$.afid["$"]')}, {_text("f", "$.afid")}), 'name', {_text("f", "$.affilname")},
        'city', {_text("f", '$["affiliation-city"]')},
        'country', {_text("f", '$["affiliation-country"]')}))) as {AFFILIATION})"""
    return lists.select(
        "entry_id",
        "eid",
        "title",
        "creator",
        "declared_authors",
        F.expr(author).alias("author"),
        F.expr(affiliation).alias("affiliation"),
        "harvested_at",
    )


def latest(entries: DataFrame) -> DataFrame:
    """One canonical row per ``entry_id``: the latest.

    A grouped maximum, not a window: it combines before the shuffle, so an entry
    delivered a million times is one row per map task, not one huge group.
    """
    content = [c for c in CANONICAL if c != "entry_id"]
    row = F.struct(F.col("harvested_at"), F.xxhash64(*content).alias("told_apart"), *[c for c in content if c != "harvested_at"])
    # Arrays of structs are orderable, so max() over the struct is defined; the hash settles equal times first.
    best = entries.groupBy("entry_id").agg(F.max(row).alias("r"))
    return best.select("entry_id", *[F.col(f"r.{c}").alias(c) for c in content])


def entry_table(entries: DataFrame) -> DataFrame:
    """``entry_id, eid, title, creator, declared_authors, n_authors, n_affiliations, harvested_at``: one row per entry."""
    held = "size(filter(coalesce({0}, array()), x -> x is not null))"
    return entries.select(
        "entry_id",
        "eid",
        "title",
        "creator",
        "declared_authors",
        F.expr(held.format("author")).cast("int").alias("n_authors"),
        F.expr(held.format("affiliation")).cast("int").alias("n_affiliations"),
        "harvested_at",
    )


def author_table(entries: DataFrame) -> DataFrame:
    """``entry_id, author_pos, seq, name``: one row per non-null author."""
    rows = """filter(transform(author, (a, i) -> if(a is null, null, named_struct(
        'entry_id', entry_id, 'author_pos', cast(i + 1 as bigint), 'seq', a.seq, 'name', a.name))),
        r -> r is not null)"""
    return entries.select(F.inline(F.expr(rows)))


def affiliation_table(entries: DataFrame) -> DataFrame:
    """``entry_id, affil_pos, afid, name, city, country``: one row per non-null affiliation, repeats included."""
    rows = """filter(transform(affiliation, (f, i) -> if(f is null, null, named_struct(
        'entry_id', entry_id, 'affil_pos', cast(i + 1 as bigint), 'afid', f.afid, 'name', f.name,
        'city', f.city, 'country', f.country))), r -> r is not null)"""
    return entries.select(F.inline(F.expr(rows)))


def link_table(entries: DataFrame, keep_unlinked: bool = False) -> DataFrame:
    """``entry_id, author_pos, affil_pos``: one row per author and distinct affiliation of the entry the author bears.

    With ``keep_unlinked`` an author without any such affiliation gives one row with position 0.
    """
    positions = """array_sort(array_distinct(filter(transform(a.afids,
        x -> cast(array_position(ids, x) as bigint)), p -> p > 0)))"""
    none = "array(0L)" if keep_unlinked else "cast(array() as array<bigint>)"
    rows = f"""flatten(transform(author, (a, i) -> if(a is null, array(), transform(
        if(coalesce(size({positions}), 0) > 0, {positions}, {none}),
        p -> named_struct('entry_id', entry_id, 'author_pos', cast(i + 1 as bigint), 'affil_pos', p)))))"""
    ids = F.expr("coalesce(transform(affiliation, f -> f.afid), cast(array() as array<string>))").alias("ids")
    return entries.select("entry_id", "author", ids).select(F.inline(F.expr(rows)))


def canonical(typed: DataFrame | None, raw: DataFrame | None) -> DataFrame:
    """The latest delivery of each entry of either table, in canonical form."""
    parts = ([canonical_typed(typed)] if typed is not None else []) + ([canonical_raw(raw)] if raw is not None else [])
    if not parts:
        raise ValueError("canonical() needs a table")
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return latest(both)


def flatten(entries: DataFrame) -> dict[str, DataFrame]:
    """The four flat tables of canonical entries: entries, authors, affiliations and author-affiliation links."""
    return {
        "entries": entry_table(entries),
        "authors": author_table(entries),
        "affiliations": affiliation_table(entries),
        "links": link_table(entries),
    }

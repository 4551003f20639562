"""Equi join with hot keys: Bloom semi-join reduction both ways, then a shuffle-hash join whose hot keys are split.

Each side's keys go into a Bloom filter of a fixed size. Filters are summed up by or, task by task and block by block, so
no task sees more than its share of them. A row that misses the other side's filter surely has no partner: it goes to the
outer output without a shuffle of the join. The others, the filter's false positives among them, are joined exactly.

A key is hot when it holds one part in `share` of its side's surviving rows. There can be at most `share` such keys a side,
whatever the input's size; their list is broadcast, and their rows are dealt to as many tasks as their part asks for.

:func:`join` gives the joined rows; :func:`with_partners` gives each row once with sums over its partners, for results
that the pairs of hot keys (their number is a product) would be too many for.

Odd input: null keys match nothing. Empty tables give empty joins or outer rows alone. Rows that occur several times take
part each. Keys of two types are compared in the type that a union of both would have. Columns of any name pass; where both
sides have a name (but for the key), the right one gets underscores. Texts are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, packed

#: Bits of a Bloom filter: 2 MB, broadcast. Beyond some two million keys more false positives survive; results stay exact.
BITS = 1 << 24
#: A key with one part in so many of its side's surviving rows is hot.
SHARE = 4096
#: In :func:`join`, a hot key's rows are cut so that a task builds its hash table from about so many of them.
CELL = 50_000

_WORD, _CHUNK = 64, 1024


def _places(key: Column, bits: int) -> dict[str, Column]:
    """Where a key lies in a filter: chunk and place of its 64-bit word, and the four bits there."""
    block = F.xxhash64(key).bitwiseAND(F.lit(bits // _WORD - 1))
    other = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(other, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return {"chunk": F.shiftright(block, 10), "at": block.bitwiseAND(F.lit(_CHUNK - 1)).cast("int"), "mask": mask}


def _dense(words: DataFrame) -> DataFrame:
    """(chunk, at, word) as one array of _CHUNK words a chunk."""
    by_place = words.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))
    return by_place.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(_CHUNK - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("words"))


def bloom(rows: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """The Bloom filter (chunk, words) of the keys that are not null; bits is a power of two from 65,536 on."""
    if bits < _WORD * _CHUNK or bits & (bits - 1):
        raise ValueError(f"bits: a power of two from {_WORD * _CHUNK} on")
    placed = rows.where(key.isNotNull()).select(*[c.alias(n) for n, c in _places(key, bits).items()])
    return _dense(placed.groupBy("chunk", "at").agg(F.bit_or("mask").alias("word")))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of all keys that are in either of two filters of the same size."""
    words = one.union(other).select("chunk", F.posexplode("words").alias("at", "word"))
    return _dense(words.groupBy("chunk", "at").agg(F.bit_or("word").alias("word")))


def probed(rows: DataFrame, key: Column, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """rows with maybe: false where the key is null or surely not in the filter, which is broadcast (its size is fixed)."""
    places = _places(key, bits)
    found = rows.join(F.broadcast(keys.withColumnsRenamed({"chunk": "bloom_chunk", "words": "bloom_words"})), F.col("bloom_chunk") == places["chunk"], "left")
    hit = F.get("bloom_words", places["at"]).bitwiseAND(places["mask"]) == places["mask"]
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(key.isNotNull() & hit, F.lit(False)).alias("maybe"))


def reduced(left: DataFrame, right: DataFrame, key: str, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Both sides as (row struct, key, maybe), each probed with the other's filter."""
    kind = left.select(F.col(f"`{key}`")).union(right.select(F.col(f"`{key}`"))).schema[0].dataType
    sides = [packed(rows, key=F.col(f"`{key}`").cast(kind)) for rows in (left, right)]
    filters = [bloom(side, F.col("key"), bits) for side in sides]
    return probed(sides[0], F.col("key"), filters[1], bits), probed(sides[1], F.col("key"), filters[0], bits)


def _facts(rows: DataFrame, aggregates: list[Column]) -> DataFrame:
    """(key, rows, facts) of each key: facts is a struct of the aggregates f_0, f_1 ... over the columns of the packed row."""
    plain = rows.select("key", "row.*") if not any(c.lower() == "key" for c in rows.select("row.*").columns) else rows.select("row.*", F.col("key").alias("key__"))
    by = "key" if plain.columns[0] == "key" else "key__"
    sums = [c.alias(f"f_{k}") for k, c in enumerate(aggregates)]
    out = plain.groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("rows"), *sums)
    return out.select("key", "rows", F.struct(F.lit(True).alias("known"), *[f"f_{k}" for k in range(len(aggregates))]).alias("facts"))


def _total(facts: DataFrame) -> int:
    return facts.agg(F.sum("rows")).first()[0] or 0


def _join_facts(rows: DataFrame, own: DataFrame, theirs: DataFrame, share: int) -> DataFrame:
    """Each of rows(row, key) with the facts of its partners, null if there are none.

    The parts of a hot key are joined with a copy of its one row of facts each: at most 2 * share copies in all."""
    each = max(1, -(-_total(own) // share))
    hot = own.where(F.col("rows") >= each).select("key", F.ceil(F.col("rows") / F.lit(each)).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # at most share rows
    dealt = rows.join(hot, "key", "left").select("row", "key", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("part"))
    copies = theirs.join(hot, "key", "left").select("key", "facts", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"))
    return dealt.join(copies.hint("shuffle_hash"), ["key", "part"], "left").select("row", "key", "facts")


def with_partners(left: DataFrame, right: DataFrame, key: str, of_left: dict[str, Column], of_right: dict[str, Column], scratch: Scratch, bits: int = BITS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(left rows with partners and of_right, right rows with partners and of_left): partners is the number of rows of the
    other side with an equal key, the aggregates are over these, null where there are none.

    Pairs are never made. Rows that are equal in all columns lie in one part of a hot key: sum up copies before, where one
    row may have very many. Facts of both sides are written to the scratch folder."""
    sides = reduced(left, right, key, bits)
    facts = [scratch.write(_facts(rows.where("maybe"), [F.count(F.lit(1)), *more.values()])) for rows, more in zip(sides, (of_left, of_right), strict=True)]
    out = []
    for rows, own, theirs, more in ((sides[0], *facts, of_right), (sides[1], *facts[::-1], of_left)):
        joined = _join_facts(rows.where("maybe").select("row", "key"), own, theirs, share)
        alone = rows.where("NOT maybe").select("row", "key", F.lit(None).cast(theirs.schema["facts"].dataType).alias("facts"))
        names = rows.select("row.*").columns
        sums = [F.coalesce("facts.f_0", F.lit(0).cast("long")).alias(free_name("partners", names)), *[F.col(f"facts.f_{k}").alias(free_name(n, names)) for k, n in enumerate(more, 1)]]
        out.append(joined.unionByName(alone).select("row.*", *sums))
    return out[0], out[1]


def join(left: DataFrame, right: DataFrame, key: str, scratch: Scratch, how: str = "inner", bits: int = BITS, share: int = SHARE) -> DataFrame:
    """The joined rows, as left.join(right, key, how) gives them (how: inner, left, right or full).

    The two sides of a hot key are cut into parts of about CELL rows, and each part of one side meets each of the other.
    Equal rows of a hot key are counted first and spread again after, so that copies do not lie in one part. Columns of
    hot rows must be of kinds that can be grouped by."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"how: {how!r}")
    sides = reduced(left, right, key, bits)
    facts = [scratch.write(_facts(rows.where("maybe"), [])) for rows in sides]
    n = [F.col(f"n_{k}") for k in (0, 1)]
    each = [max(1, -(-_total(f) // share)) for f in facts]
    both = facts[0].select("key", F.col("rows").alias("n_0")).join(facts[1].select("key", F.col("rows").alias("n_1")), "key")
    hot = scratch.write(both.where((n[0] >= each[0]) | (n[1] >= each[1])).select("key", *[F.ceil(c / F.lit(CELL)).cast("int").alias(f"parts_{k}") for k, c in enumerate(n)]))
    there = [F.broadcast(hot.select("key", F.col(f"parts_{k}").alias("own"), F.col(f"parts_{1 - k}").alias("other"))) for k in (0, 1)]  # at most 2 * share rows

    def part(k: int) -> DataFrame:
        rows = sides[k].where("maybe").select(F.col("row").alias(f"row_{k}"), "key")
        tagged = rows.join(there[k], "key", "left")
        once = tagged.where("own IS NOT NULL").groupBy("key", f"row_{k}", "own", "other").agg(F.count(F.lit(1)).cast("int").alias(f"copies_{k}"))
        cut = once.withColumn(f"part_{k}", F.pmod(F.xxhash64(f"row_{k}"), F.col("own")).cast("int")).withColumn(f"part_{1 - k}", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
        rest = tagged.where("own IS NULL").select("key", f"row_{k}", F.lit(1).alias(f"copies_{k}"), F.lit(-1).alias(f"part_{k}"), F.lit(-1).alias(f"part_{1 - k}"))
        return cut.select(*rest.columns).unionByName(rest)

    pairs = part(0).join(part(1).hint("shuffle_hash"), ["key", "part_0", "part_1"])
    pairs = pairs.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_0").cast("long") * F.col("copies_1")))).select("key", "row_0", "row_1")
    kinds = [s.schema["row"].dataType for s in sides]
    for k, asked in ((0, how in ("left", "full")), (1, how in ("right", "full"))):
        if asked:
            kept = _join_facts(sides[k].where("maybe").select("row", "key"), facts[k], facts[1 - k], share).where("facts IS NULL").select("row", "key")
            rows = kept.unionByName(sides[k].where("NOT maybe").select("row", "key"))
            pairs = pairs.unionByName(rows.select("key", F.col("row").alias(f"row_{k}"), F.lit(None).cast(kinds[1 - k]).alias(f"row_{1 - k}")))
    names = [key, *[c for c in left.columns if c != key]]
    columns = [F.col("key").alias(key), *[F.col(f"row_0.`{c}`").alias(c) for c in names[1:]]]
    for c in right.columns:
        if c != key:
            columns.append(F.col(f"row_1.`{c}`").alias(name := free_name(c, names)))
            names.append(name)
    return pairs.select(*columns)


def shop_rows(rows: DataFrame, ident: str, amount: str) -> DataFrame:
    """(id, key, copies, crc) of a shop table: the key is client_id, but for ids whose crc32 ends below 3, which share seven
    keys; copies are the rows with this id and key, crc the sum of crc32 of `id:cents` over them."""
    h = F.crc32(F.col(ident).cast("string"))
    key = F.when(h % 10 < 3, F.floor(h / 10) % 7).otherwise(F.col("client_id")).cast("long")
    x = F.col(amount)
    cents = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "").otherwise(F.floor(x * 100 + 0.5).cast("string"))
    plain = rows.select(F.col(ident).cast("long").alias("id"), key.alias("key"), F.crc32(F.concat(F.col(ident).cast("string"), F.lit(":"), cents)).alias("crc"))
    return plain.groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"), F.sum("crc").alias("crc"))


def report(clicks: DataFrame, sales: DataFrame, bits: int = BITS, share: int = SHARE) -> DataFrame:
    """side, id, client_id, copies, inner_rows, left_rows, full_rows, partner_crc of every id of both tables.

    Copies of an id are summed up before the join; of an id with several keys the smallest is shown, and all count. Amounts
    that are not finite count as null. Rows without an id form one id, null, whose partners see it as null (they add 0)."""
    scratch = Scratch(clicks.sparkSession, "hot_join")
    sides = [scratch.write(shop_rows(clicks, "click_id", "value")), scratch.write(shop_rows(sales, "sale_id", "total"))]
    sums = {"there": F.sum("copies"), "there_crc": F.coalesce(F.sum("crc"), F.lit(0).cast("long"))}
    found = with_partners(*sides, "key", sums, sums, scratch, bits, share)
    zero = F.lit(0).cast("long")
    rows = found[0].withColumn("side", F.lit("click")).unionByName(found[1].withColumn("side", F.lit("sale")))
    rows = rows.withColumns({"there": F.coalesce("there", zero), "there_crc": F.coalesce("there_crc", zero)})
    outer = F.col("copies") * F.greatest("there", F.lit(1).cast("long"))
    inner = F.col("copies") * F.col("there")
    return rows.groupBy("side", "id").agg(
        F.min("key").alias("client_id"), F.sum("copies").alias("copies"), F.sum(inner).alias("inner_rows"),
        F.sum(F.when(F.col("side") == "click", outer).otherwise(inner)).alias("left_rows"), F.sum(outer).alias("full_rows"),
        F.sum(F.col("copies") * F.col("there_crc")).alias("partner_crc"),
    )


def _crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII text, byte by byte; column t is the polynomial's table."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295::BIGINT)"


def _side_sql(table: str, ident: str, amount: str) -> str:
    cents = f"coalesce(CASE WHEN isfinite({amount}) THEN CAST(CAST(floor(100 * {amount} + 0.5) AS BIGINT) AS VARCHAR) END, '')"
    return f"SELECT id, CASE WHEN h % 10 < 3 THEN (h // 10) % 7 ELSE client_id END AS key, {_crc_sql('text')} AS crc FROM (SELECT {ident} AS id, client_id, {_crc_sql(f'CAST({ident} AS VARCHAR)')} AS h, CAST({ident} AS VARCHAR) || ':' || {cents} AS text, t FROM {table}, crc_table)"


#: Sums by key stand for the pairs: these are thousands of millions on the larger tables. A test holds both against real joins.
ORACLE = f"""
WITH crc_table AS (SELECT list(list_reduce(list_prepend(n, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda c, one: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT range::BIGINT AS n FROM range(256))),
c AS MATERIALIZED ({_side_sql('clicks', 'click_id', 'value')}),
s AS MATERIALIZED ({_side_sql('sales', 'sale_id', 'total')}),
ck AS (SELECT key, count(*) AS n, sum(crc) AS crc FROM c GROUP BY 1),
sk AS (SELECT key, count(*) AS n, sum(crc) AS crc FROM s GROUP BY 1),
r AS (SELECT 'click' AS side, c.id, c.key, coalesce(k.n, 0) AS n, coalesce(k.crc, 0) AS crc FROM c LEFT JOIN sk k ON c.key = k.key
      UNION ALL SELECT 'sale', s.id, s.key, coalesce(k.n, 0), coalesce(k.crc, 0) FROM s LEFT JOIN ck k ON s.key = k.key)
SELECT side, CAST(id AS BIGINT) AS id, CAST(min(key) AS BIGINT) AS client_id, count(*) AS copies, CAST(sum(n) AS BIGINT) AS inner_rows,
       CAST(sum(CASE WHEN side = 'click' THEN greatest(n, 1) ELSE n END) AS BIGINT) AS left_rows, CAST(sum(greatest(n, 1)) AS BIGINT) AS full_rows,
       CAST(sum(crc) AS BIGINT) AS partner_crc
FROM r GROUP BY side, id
"""

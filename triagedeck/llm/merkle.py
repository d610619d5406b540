"""Merkle manifest of a table: few stored levels, the others recomputed where a proof needs them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .base import UPPER, in_order, numbered, query, table

FANOUT = 8
EVERY = 2  # levels from one stored level to the next
PATH = "array<struct<before:string,after:string>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """Hash of a row's values, each as byte count, ``:`` and value, or ``-`` where missing."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass(frozen=True)
class Manifest:
    """Stored levels (grp, idx, n, digest), the leaves first, one node a group last."""

    levels: list[DataFrame]
    fanout: int
    every: int

    @property
    def tops(self) -> DataFrame:
        return self.levels[-1]


def _subtrees(nodes: DataFrame, fanout: int, every: int, extra: Sequence[str] = ()) -> DataFrame:
    """Aligned subtrees of a stored level, with the levels between it and the next one made anew.

    One row for each run of fanout ** every nodes: ``l0`` (the stored digests), ``l1``, ..., each as far as the
    group still has several nodes, and ``top``.
    """
    span = fanout**every
    rows = nodes.groupBy("grp", F.expr(f"idx div {span}").alias("up")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest", *extra))).alias("nodes")
    )
    rows = rows.withColumn("l0", F.expr("nodes.digest"))
    top = "l0[0]"
    for k in range(1, every + 1):
        runs = (
            f"transform(sequence(0, (size(l{k - 1}) - 1) div {fanout}),"
            f" i -> sha2(array_join(slice(l{k - 1}, i * {fanout} + 1, {fanout}), ''), 256))"
        )
        rows = rows.withColumn(f"l{k}", F.expr(f"if(n > {fanout ** (k - 1)}, {runs}, null)"))
        top = f"coalesce(l{k}[0], {top})"
    return rows.withColumn("top", F.expr(top))


def build(leaves: DataFrame, fanout: int = FANOUT, every: int = EVERY, name: str = "merkle") -> Manifest:
    """Hash each group's nodes upwards until one is left, and store every ``every``-th level.

    ``leaves`` (grp, idx, n, digest): ``idx`` counts from 0 in each group of ``n``. A task holds fanout ** every nodes at a
    time, however large a group is. A group of one leaf has that leaf as its top.
    """
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        span = fanout**every
        above = _subtrees(levels[-1].select("grp", "idx", "n", "digest"), fanout, every).select(
            "grp", F.col("up").alias("idx"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("top").alias("digest")
        )
        levels.append(materialise(above, f"{name}_{every * len(levels)}"))
    return Manifest(levels, fanout, every)


def _steps(fanout: int, every: int) -> str:
    """The path of node ``j`` within its subtree: what stands before and after it in its run, level by level."""
    steps = []
    for k in range(every):
        at = f"(j div {fanout**k})"
        before = f"array_join(slice(l{k}, ({at} div {fanout}) * {fanout} + 1, {at} % {fanout}), '')"
        after = f"array_join(slice(l{k}, {at} + 2, {fanout - 1} - {at} % {fanout}), '')"
        steps.append(f"if(n > {fanout**k}, array(struct({before} AS before, {after} AS after)), cast(array() AS {PATH}))")
    return f"concat({', '.join(steps)})"


def proofs(manifest: Manifest, tops: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Every leaf with its ``path``: the siblings before and after it on each level, as strings of digests.

    ``tops`` (grp, path, ...) continues the path of each group's top, if that is a leaf of another tree; its further
    columns go to all leaves of the group. From the highest stored level down, each aligned subtree's missing
    levels are made anew, its nodes' siblings emitted, and the rest dropped. A subtree meets the one path of its top, so
    long paths travel once per subtree, not per leaf.
    """
    start = manifest.tops.select("grp", "idx")
    if tops is None:
        above = start.withColumn("path", F.expr(f"cast(array() AS {PATH})"))
    else:
        above = (
            start.withColumn("_g", F.struct("grp"))
            .join(tops.withColumn("_g", F.struct("grp")).drop("grp"), "_g")
            .drop("_g")
        )
    more = [c for c in above.columns if c not in ("grp", "idx", "path")]
    for k in range(len(manifest.levels) - 2, -1, -1):
        own = list(extra) if k == 0 else []
        trees = _subtrees(manifest.levels[k], manifest.fanout, manifest.every, own)
        joined = (
            trees.withColumn("_at", F.struct("grp", F.col("up").alias("idx")))
            .join(above.withColumn("_at", F.struct("grp", "idx")).select("_at", "path", *more), "_at")
            .select("grp", "n", "path", *more, *[f"l{i}" for i in range(manifest.every)], F.posexplode("nodes").alias("j", "node"))
        )
        steps = F.expr(f"concat({_steps(manifest.fanout, manifest.every)}, path)")
        above = joined.select(
            "grp", "node.idx", "node.digest", steps.alias("path"), *more, *[f"node.{c}" for c in own]
        )
    if len(manifest.levels) == 1:
        at = F.struct("grp", "idx")
        above = manifest.levels[0].withColumn("_at", at).join(
            above.withColumn("_at", at).drop("grp", "idx"), "_at"
        ).select("grp", "idx", "digest", "path", *more, *extra)
    return above


def fold(leaf: Column | str, path: Column | str) -> Column:
    """The top that a leaf and the siblings on its path lead to."""
    leaf, path = (F.col(c) if isinstance(c, str) else c for c in (leaf, path))
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_text(path: Column | str) -> Column:
    """All siblings on a path, from the leaf upwards, left to right."""
    path = F.col(path) if isinstance(path, str) else path
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def merkle_proofs(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group_col: str = "lang",
    order_col: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    every: int = EVERY,
) -> DataFrame:
    """Manifest of a table and a proof for each row.

    One tree per value of ``group_col``, its leaves ascending by ``order_col`` (missing first, then by hash), and one tree over
    their tops, ordered by group (missing first, by UTF-8 bytes). ``tampered`` gives other values of some columns for
    the recomputation. Returns, per row, the order column, ``leaf``, ``subroot``, ``root``, ``path``,
    ``folded_root`` (from the tampered leaf and the original siblings) and ``verified``.

    Only digests are sorted and shuffled, never the texts: a long text costs its scan. Repeated rows are
    leaves of their own with equal hashes; a table with one row has that leaf as root; an empty
    table gives an empty table. Other columns are not looked at.
    """
    now = {c: F.col(f"`{c}`") for c in columns}
    changed = {c: (tampered or {}).get(c, v) for c, v in now.items()}
    hashed = materialise(
        docs.select(
            F.col(f"`{group_col}`").alias("grp"),
            F.col(f"`{order_col}`").alias("key"),
            leaf_digest(*now.values()).alias("digest"),
            leaf_digest(*changed.values()).alias("changed"),
        ),
        "leaf_digests",
    )
    ordered = in_order(hashed, F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), "digest", name="leaves_sorted")
    leaves = materialise(numbered(ordered, "grp"), "leaves")
    trees = build(leaves, fanout, every, "subtree")
    heads = in_order(
        trees.tops.select(F.lit(0).alias("all"), "grp", "digest"), F.col("grp").asc_nulls_first(), name="heads"
    )
    top = numbered(heads, "all").select(F.col("all").alias("grp"), "idx", "n", "digest", F.col("grp").alias("group"))
    whole = build(materialise(top, "subroots"), fanout, every, "root")
    found = whole.tops.select("digest").first()
    root = F.lit(found[0] if found else None).cast("string")
    heads_up = proofs(whole, extra=["group"]).select(F.col("group").alias("grp"), "path", F.col("digest").alias("subroot"))
    rows = proofs(trees, materialise(heads_up, "subroot_paths"), ["key", "changed"])
    folded = rows.withColumn("folded_root", fold("changed", "path"))
    return folded.select(
        F.col("key").alias(order_col),
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        "path",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


# --- the same in SQL: eight levels in each tree, enough for 16 million rows a group ---

SQL_LEVELS = 8


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text; the polynomial is that of RFC 1952."""
    step = (
        "list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),"
        " lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    )
    codes = f"[ascii(c)::BIGINT FOR c IN string_split(coalesce({text}, ''), '') IF c <> '']"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, b: {step}), 4294967295)"


def _tree_sql(p: str, source: str) -> list[str]:
    """Levels 0 to 8 of the trees of ``source`` (grp, idx, n, d), and each node's siblings."""
    ctes = [f"{p}0 AS (SELECT grp, idx, n, d FROM {source})"]
    for k in range(SQL_LEVELS):
        ctes.append(
            f"""{p}s{k} AS (SELECT grp, idx, n,
    coalesce(string_agg(d, '') OVER (PARTITION BY grp, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bf,
    coalesce(string_agg(d, '') OVER (PARTITION BY grp, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS af
  FROM {p}{k})"""
        )
        ctes.append(
            f"""{p}{k + 1} AS (SELECT grp, idx // 8 AS idx, (max(n) + 7) // 8 AS n,
    CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE max(d) END AS d
  FROM {p}{k} GROUP BY grp, idx // 8)"""
        )
    return ctes


def _walk_sql(p: str, base: str, keep: str, tree: str) -> list[str]:
    """Fold ``f`` and siblings ``pr`` of ``base`` (g, i, f, pr, ...) upwards through a tree."""
    ctes, last = [], base
    for k in range(SQL_LEVELS):
        ctes.append(
            f"""{p}{k} AS (SELECT {keep}, g, i // 8 AS i,
    CASE WHEN s.n > 1 THEN sha256(s.bf || b.f || s.af) ELSE b.f END AS f,
    CASE WHEN s.n > 1 THEN b.pr || s.bf || s.af ELSE b.pr END AS pr
  FROM {last} b JOIN {tree}s{k} s ON b.g IS NOT DISTINCT FROM s.grp AND b.i = s.idx)"""
        )
        last = f"{p}{k}"
    return ctes


def _value_sql(c: str) -> str:
    return f"coalesce(strlen({c}) || ':' || {c}, '-')"


_KEPT = "doc_id, leaf, subroot, root"
_LEAF = " || ".join(_value_sql(f"{c}::VARCHAR") for c in COLUMNS)
_CHANGED = " || ".join(
    _value_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')" if c == "text" else f"{c}::VARCHAR") for c in COLUMNS
)
MERKLE_SQL = "WITH " + ",\n".join(
    [
        f"""hashed AS (SELECT doc_id, lang AS grp, sha256({_LEAF}) AS d,
    CASE WHEN {crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_CHANGED}) ELSE sha256({_LEAF}) END AS changed FROM documents)""",
        """leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS idx,
    count(*) OVER (PARTITION BY grp) AS n FROM hashed)""",
        *_tree_sql("t", "leaves"),
        f"""heads AS (SELECT 0 AS grp, grp AS lang, d, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx,
    count(*) OVER () AS n FROM t{SQL_LEVELS})""",
        *_tree_sql("h", "heads"),
        f"""base AS (SELECT l.doc_id, l.d AS leaf, h.d AS subroot, (SELECT d FROM h{SQL_LEVELS}) AS root,
    l.grp AS g, l.idx AS i, l.changed AS f, '' AS pr, h.idx AS place
  FROM leaves l JOIN heads h ON l.grp IS NOT DISTINCT FROM h.lang)""",
        *_walk_sql("w", "base", _KEPT + ", place", "t"),
        f"up AS (SELECT {_KEPT}, 0 AS g, place AS i, f, pr FROM w{SQL_LEVELS - 1})",
        *_walk_sql("v", "up", _KEPT, "h"),
    ]
) + f"""
SELECT doc_id, leaf, subroot, root, sha256(pr) AS proof_sha256, f AS folded_root, f = root AS verified
FROM v{SQL_LEVELS - 1}"""


@query("op12_merkle", MERKLE_SQL)
def op12(spark, sf):
    docs = table(spark, sf, "documents").select(*COLUMNS)
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    lowered = F.when(hit, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    rows = merkle_proofs(docs, tampered={"text": lowered})
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text("path"), 256).alias("proof_sha256"), "folded_root", "verified"
    )

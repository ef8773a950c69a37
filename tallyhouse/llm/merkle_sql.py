"""Check SQL of ``op12_merkle_manifest``."""

from __future__ import annotations

from tallyhouse.llm.merkle import FIELDS


def _leaf(changed: bool = False) -> str:
    values = [f"({f} + 1)" if changed and f == "n_chars" else f for f in FIELDS]
    texts = [f"{v}::VARCHAR" for v in values]
    return f"sha256({' || '.join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts)})"


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees in ``leaves`` (tree, place, node)."""
    return f"""{name} AS (
      SELECT tree, 0 AS level, place, node FROM {leaves}
      UNION ALL
      SELECT tree, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place))
      FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1
      GROUP BY tree, level, place // 2),
    {name}_root AS (SELECT tree, max(level) AS height, arg_max(node, level) AS root FROM {name} GROUP BY tree)"""


def _folded(name: str, starts: str, nodes: str) -> str:
    """``starts`` (id, tree, place, node, proof) on every level up to the root."""
    return f"""{name} AS (
      SELECT id, tree, 0 AS level, place, node, proof FROM {starts}
      UNION ALL
      SELECT f.id, f.tree, f.level + 1, f.place // 2,
        sha256(CASE WHEN s.node IS NULL THEN f.node WHEN f.place % 2 = 1 THEN s.node || f.node
                    ELSE f.node || s.node END), f.proof || coalesce(s.node, '')
      FROM {name} f JOIN {nodes}_root r ON r.tree = f.tree AND f.level < r.height
        LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.place = xor(f.place, 1::BIGINT)),
    {name}_top AS (SELECT f.* FROM {name} f JOIN {nodes}_root r ON r.tree = f.tree AND f.level = r.height)"""


MANIFEST = f"""WITH RECURSIVE
    crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i)) AS t),
    crcs AS (SELECT d.*, t, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS b
      FROM documents d, crc_table),
    rows_ AS (SELECT doc_id, lang, {_leaf()} AS leaf,
        CASE WHEN xor(4294967295::BIGINT, list_reduce(b,
          lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 7 = 0
        THEN {_leaf(True)} ELSE {_leaf()} END AS present FROM crcs),
    leaves AS (SELECT row_number() OVER () AS id, doc_id, leaf, present, leaf AS node,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows_),
    {_levels("nodes", "leaves")},
    subroots AS (SELECT 0 AS tree, tree AS place, root AS node FROM nodes_root),
    {_levels("uppers", "subroots")},
    starts AS (SELECT id, tree, place, present AS node, '' AS proof FROM leaves),
    {_folded("folds", "starts", "nodes")},
    upper_starts AS (SELECT id, 0 AS tree, tree AS place, node, proof FROM folds_top),
    {_folded("tops", "upper_starts", "uppers")}
    SELECT l.doc_id, l.leaf, r.root AS subroot, u.root, sha256(t.proof) AS proof_sha256,
      t.node AS folded_root, t.node = u.root AS verified
    FROM leaves l JOIN nodes_root r ON r.tree = l.tree JOIN tops_top t ON t.id = l.id, uppers_root u"""

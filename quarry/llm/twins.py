"""SQL twins of operators whose rounds are unrolled, as text made from a rule."""

from __future__ import annotations

from quarry.llm.merkle import FAN_OUT

#: CRC-32 of a text of one-byte characters, a bit at a time (reflected polynomial EDB88320).
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""


def merkle_sql(lower: int = 7, upper: int = 3) -> str:
    """The manifest's proofs, for groups of FAN_OUT^lower rows and FAN_OUT^upper groups at most."""

    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"base AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lowered)} END AS altered FROM documents)",
        "a0 AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM base)",
    ]

    def levels(tree: str, group: str, count: int) -> None:
        for k in range(count):
            ctes.append(f"""{tree}s{k} AS (SELECT {group} AS g, r, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {tree}{k} WHERE n > 1 WINDOW w AS (PARTITION BY {group}, r // {FAN_OUT} ORDER BY r))""")
            ctes.append(f"{tree}{k + 1} AS (SELECT {group}, r // {FAN_OUT} AS r, sha256(string_agg(node, '' ORDER BY r)) AS node, (min(n) + {FAN_OUT - 1}) // {FAN_OUT} AS n FROM {tree}{k} WHERE n > 1 GROUP BY {group}, r // {FAN_OUT})")

    levels("a", "lang", lower)
    subroots = " UNION ALL ".join(f"SELECT lang, node FROM a{k} WHERE n = 1" for k in range(lower + 1))
    ctes.append(f"b0 AS (SELECT 0 AS one, lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM ({subroots}))")
    levels("b", "one", upper)
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT node FROM b{k} WHERE n = 1" for k in range(upper + 1)) + ")")
    ctes.append("f0 AS (SELECT a0.doc_id, a0.lang, a0.leaf, b0.node AS subroot, a0.r, b0.r AS br, coalesce(a0.altered, a0.leaf) AS f, '' AS proof FROM a0 JOIN b0 ON a0.lang IS NOT DISTINCT FROM b0.lang)")
    steps = [("a", "lang", "r", k) for k in range(lower)] + [("b", "0", "br", k) for k in range(upper)]
    for i, (tree, group, rank, k) in enumerate(steps):
        ctes.append(f"""f{i + 1} AS (SELECT x.* REPLACE (CASE WHEN s.before IS NULL THEN f ELSE sha256(s.before || f || s.after) END AS f, proof || coalesce(s.before || s.after, '') AS proof)
            FROM f{i} x LEFT JOIN {tree}s{k} s ON s.g IS NOT DISTINCT FROM {'x.' + group if group == 'lang' else group} AND s.r = x.{rank} // {FAN_OUT**k})""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.node AS verified FROM f{len(steps)} CROSS JOIN root"

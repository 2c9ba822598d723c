"""op13: the prefix trie of all conversations."""
from beaconlake.llm import turn_trie
from beaconlake.llm.queries import query

#: CRC-32 bit by bit; prefixes as lists of turns.
SQL = """
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) - 1 AS p,
  struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
built AS (SELECT c.conv_id, coalesce((SELECT list(o.said ORDER BY o.p) FROM own o WHERE o.conv_id = c.conv_id - c.conv_id % 5 AND o.p < c.h), [])
  || coalesce((SELECT list(o.said ORDER BY o.p) FROM own o WHERE o.conv_id = c.conv_id AND o.p >= c.h), []) AS path FROM convs c),
steps AS (SELECT conv_id, len(path) AS turns, unnest(range(0, len(path) + 1)) AS depth, path FROM built),
members AS (SELECT conv_id, turns, depth, path[1:depth] AS node, CASE WHEN depth > 0 THEN strlen(path[depth].t) ELSE 0 END AS bytes FROM steps),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256 FROM members GROUP BY node, depth),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[1:n.depth] = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]),
above AS (SELECT node[1:up] AS node, n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM linked)),
sums AS (SELECT node, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN sums USING (node)
"""


@query("op13_turn_trie", SQL)
def op13_turn_trie(spark, folder):
    return turn_trie.trie(spark.read.parquet(f"{folder}/conversations.parquet"))

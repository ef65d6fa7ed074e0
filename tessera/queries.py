"""The registered queries of the graph engine over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import query
from tessera.operators.update import update
from tessera.plans.session import shared_dir
from tessera.sources import rdf
from tessera.sources.tables import graph_of
from tessera.store import Store
from tessera.streaming.pipeline import Stream

# (SPARQL, SQL) by name; <t#c> stands for the predicate of a column, <t/> for a table's subjects.
SPARQL: dict[str, tuple[str, str]] = {
    "bgp_star": (
        "SELECT ?name ?seg ?bal { ?c <customer#c_name> ?name ; <customer#c_mktsegment> ?seg ; <customer#c_acctbal> ?bal }",
        "SELECT c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer"),
    "bgp_chain": (
        "SELECT ?region (COUNT(*) AS ?n) (SUM(?q) AS ?qty) { ?l <lineitem#ref-l_orderkey> ?o ; <lineitem#l_quantity> ?q . ?o <orders#ref-o_custkey> ?c . ?c <customer#ref-c_nationkey> ?n1 . ?n1 <nation#ref-n_regionkey> ?r . ?r <region#r_name> ?region } GROUP BY ?region",
        "SELECT r_name AS region, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "bgp_cycle": (
        "SELECT (COUNT(*) AS ?n) { ?l <lineitem#ref-l_orderkey> ?o ; <lineitem#ref-l_suppkey> ?s . ?s <supplier#ref-s_nationkey> ?nat . ?o <orders#ref-o_custkey> ?c . ?c <customer#ref-c_nationkey> ?nat }",
        "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = c_nationkey"),
    "repeated_var": ("SELECT ?x { ?e <events#user_id> ?x ; <events#event_id> ?x }", "SELECT user_id AS x FROM events WHERE user_id = event_id"),
    "bound_subject": ("SELECT ?n ?k { <nation/3> <nation#n_name> ?n ; <nation#n_regionkey> ?k }", "SELECT n_name AS n, n_regionkey::BIGINT AS k FROM nation WHERE n_nationkey = 3"),
    "variable_predicate": ("SELECT ?p (COUNT(*) AS ?n) { <nation/3> ?p ?o } GROUP BY ?p", "SELECT unnest(['urn:t:nation#n_nationkey', 'urn:t:nation#n_name', 'urn:t:nation#n_regionkey', 'urn:t:nation#ref-n_regionkey']) AS p, 1::BIGINT AS n"),
    "join_subgroup": (
        "SELECT ?k ?s { { ?o <orders#o_orderkey> ?k ; <orders#ref-o_custkey> ?c ; <orders#o_totalprice> ?t FILTER(?t > 250000.0) } { ?c <customer#c_mktsegment> ?s } }",
        "SELECT o_orderkey AS k, c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000"),
    "join_maybe_unbound": (
        "SELECT ?a (COUNT(*) AS ?n) (SUM(?b) AS ?s) { { ?d <documents#doc_id> ?a OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?x } } { ?p <part#p_partkey> ?b ; <part#p_size> ?z OPTIONAL { ?p <part#p_size> ?x FILTER(?x < 2) } } } GROUP BY ?a",
        "WITH a AS (SELECT d.doc_id AS a, quality::BIGINT AS x FROM documents d LEFT JOIN labels USING (doc_id)), b AS (SELECT p_partkey AS b, CASE WHEN p_size < 2 THEN p_size END::BIGINT AS x FROM part) SELECT a, count(*) AS n, sum(b)::BIGINT AS s FROM a, b WHERE a.x IS NULL OR b.x IS NULL OR a.x = b.x GROUP BY a"),
    "optional_maybe_unbound": (
        "SELECT ?k ?q ?x { { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q } } OPTIONAL { ?n <nation#n_regionkey> ?q ; <nation#n_nationkey> ?x FILTER(?x < 9) } }",
        "WITH a AS (SELECT d.doc_id AS k, quality::BIGINT AS q FROM documents d LEFT JOIN labels USING (doc_id)), b AS (SELECT n_regionkey::BIGINT AS q, n_nationkey::BIGINT AS x FROM nation WHERE n_nationkey < 9) SELECT k, coalesce(a.q, b.q) AS q, x FROM a LEFT JOIN b ON a.q IS NULL OR b.q = a.q"),
    "optional_maybe_unbound_right": (
        "SELECT ?k ?n { ?d <documents#doc_id> ?k ; <documents#lang> ?g OPTIONAL { ?r <region#r_regionkey> ?n OPTIONAL { ?r <region#r_regionkey> ?k FILTER(?k > 2) } FILTER(?n > 0) } }",
        "WITH b AS (SELECT r_regionkey::BIGINT AS n, CASE WHEN r_regionkey > 2 THEN r_regionkey END::BIGINT AS k FROM region WHERE r_regionkey > 0) SELECT d.doc_id AS k, n FROM documents d LEFT JOIN b ON b.k IS NULL OR b.k = d.doc_id WHERE lang IS NOT NULL"),
    "minus_maybe_unbound": (
        "SELECT ?k { { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#toxic> ?t FILTER(?t = 1) } } MINUS { ?m <labels#quality> 0 OPTIONAL { ?m <labels#toxic> ?t FILTER(?t = 1) } } }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 WHERE l.toxic IS NULL OR NOT EXISTS (SELECT 1 FROM labels WHERE quality = 0 AND toxic = 1)"),
    "exists_maybe_unbound": (
        "SELECT ?k { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q } FILTER EXISTS { ?n <nation#n_nationkey> ?q ; <nation#n_regionkey> 0 } }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels USING (doc_id) WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 0 AND (quality IS NULL OR n_nationkey = quality))"),
    "not_exists_maybe_unbound": (
        "SELECT ?k { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q } FILTER NOT EXISTS { ?p <part#p_size> ?z OPTIONAL { ?p <part#p_size> ?q FILTER(?q > 1) } FILTER(?z < 4) FILTER(?z > 1) } }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size IN (2, 3) AND (quality IS NULL OR p_size = quality))"),
    "optional_plain": (
        "SELECT ?k ?q { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q } }",
        "SELECT d.doc_id AS k, quality::BIGINT AS q FROM documents d LEFT JOIN labels USING (doc_id)"),
    "optional_filter": (
        "SELECT ?k ?o { ?c <customer#c_custkey> ?k ; <customer#c_acctbal> ?b OPTIONAL { ?ord <orders#ref-o_custkey> ?c ; <orders#o_orderkey> ?o ; <orders#o_totalprice> ?t FILTER(?t > 200000.0 && ?b > 0.0) } }",
        "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 0"),
    "optional_nested": (
        "SELECT ?k ?q ?t { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q OPTIONAL { ?l <labels#toxic> ?t FILTER(?t = 1) } } }",
        "SELECT d.doc_id AS k, quality::BIGINT AS q, CASE WHEN toxic = 1 THEN 1 END::BIGINT AS t FROM documents d LEFT JOIN labels USING (doc_id)"),
    "minus_shared": (
        "SELECT ?k { ?c <customer#c_custkey> ?k MINUS { ?o <orders#ref-o_custkey> ?c ; <orders#o_totalprice> ?t FILTER(?t > 450000.0) } }",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "minus_disjoint": ("SELECT ?n { ?r <region#r_name> ?n MINUS { ?x <nation#n_name> ?y } }", "SELECT r_name AS n FROM region"),
    "filter_cmp": (
        "SELECT ?k { ?o <orders#o_orderkey> ?k ; <orders#o_totalprice> ?t ; <orders#o_orderstatus> ?s FILTER(?t >= 100000.0 && ?t < 120000.0 && ?s != \"F\") }",
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000 AND o_orderstatus <> 'F'"),
    "filter_3vl": (
        "SELECT ?k { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q } FILTER(?q = 1 || ?k < 50) }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality = 1 OR d.doc_id < 50"),
    "filter_in": ("SELECT ?k { ?p <part#p_partkey> ?k ; <part#p_size> ?s FILTER(?s IN (1, 5, 9)) }", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9)"),
    "filter_notin_err": (
        "SELECT ?k { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q } FILTER(?k NOT IN (1, 2, ?q)) }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id NOT IN (1, 2, quality)"),
    "filter_datetime": (
        'SELECT ?k { ?o <orders#o_orderkey> ?k ; <orders#o_orderdate> ?d FILTER(?d >= "1996-01-01T00:00:00"^^<http://www.w3.org/2001/XMLSchema#dateTime> && ?d < "1996-03-01T00:00:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>) }',
        "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'"),
    "union_cols": (
        "SELECT ?c ?s { { ?x <customer#c_custkey> ?c } UNION { ?y <supplier#s_suppkey> ?s } }",
        "SELECT c_custkey AS c, NULL::BIGINT AS s FROM customer UNION ALL SELECT NULL, s_suppkey FROM supplier"),
    "graph_const": ("SELECT ?k { GRAPH <urn:g:events/click> { ?e <events#event_id> ?k } }", "SELECT event_id AS k FROM events WHERE event_type = 'click'"),
    "graph_var": ("SELECT ?g ?k { GRAPH ?g { ?e <events#event_id> ?k ; <events#user_id> ?u } }", "SELECT 'urn:g:events/' || event_type AS g, event_id AS k FROM events"),
    "graph_var_agg": ("SELECT ?g ?n { GRAPH ?g { SELECT (COUNT(*) AS ?n) { ?e <events#event_id> ?k } } }", "SELECT 'urn:g:events/' || event_type AS g, count(*) AS n FROM events GROUP BY 1"),
    "graph_var_limit": (
        "SELECT ?g ?k { GRAPH ?g { SELECT ?k { ?e <events#event_id> ?k } ORDER BY DESC(?k) LIMIT 3 } }",
        "SELECT g, k FROM (SELECT 'urn:g:events/' || event_type AS g, event_id AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3"),
    "graph_empty": ("SELECT ?g { GRAPH ?g {} }", "SELECT DISTINCT 'urn:g:events/' || event_type AS g FROM events"),
    "from_union_dedup": (
        "SELECT (COUNT(*) AS ?n) FROM <urn:g:events/click> FROM <urn:g:events/purchase> { ?e <events#user_id> ?u }",
        "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'purchase')"),
    "from_named": (
        "SELECT (COUNT(*) AS ?n) FROM NAMED <urn:g:events/click> { GRAPH ?g { ?e <events#event_id> ?k } }",
        "SELECT count(*) AS n FROM events WHERE event_type = 'click'"),
    "bind_arithmetic": (
        "SELECT ?k ?r { ?l <part#p_partkey> ?k ; <part#p_size> ?s BIND(?s * 2 + 1 - ?k AS ?r) }",
        "SELECT p_partkey AS k, p_size * 2 + 1 - p_partkey AS r FROM part"),
    "bind_error_unbound": ("SELECT ?k (BOUND(?x) AS ?b) { ?n <nation#n_nationkey> ?k ; <nation#n_name> ?m BIND(?m * 2 AS ?x) }", "SELECT n_nationkey::BIGINT AS k, false AS b FROM nation"),
    "values_undef": (
        'SELECT ?k ?n { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n ; <nation#n_regionkey> ?r VALUES (?k ?r) { (1 UNDEF) (UNDEF 2) } }',
        "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation, (VALUES (1, NULL), (NULL, 2)) v(k, r) WHERE (v.k IS NULL OR v.k = n_nationkey) AND (v.r IS NULL OR v.r = n_regionkey)"),
    "values_iri": ("SELECT ?n { VALUES ?x { <nation/1> <nation/7> } ?x <nation#n_name> ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (1, 7)"),
    "values_trailing": (
        "SELECT ?k (?z + 1 AS ?y) { ?x <nation#n_nationkey> ?k } VALUES (?k ?z) { (1 10) (2 20) (UNDEF 5) }",
        "SELECT n_nationkey::BIGINT AS k, (v.z + 1)::BIGINT AS y FROM nation, (VALUES (1, 10), (2, 20), (NULL, 5)) v(k, z) WHERE v.k IS NULL OR v.k = n_nationkey"),
    "values_trailing_group": (
        "SELECT ?r (?n * ?f AS ?m) { { SELECT ?r (COUNT(*) AS ?n) { ?x <nation#n_regionkey> ?r } GROUP BY ?r } } VALUES (?r ?f) { (0 1) (1 100) }",
        "SELECT n_regionkey::BIGINT AS r, (count(*) * CASE n_regionkey WHEN 1 THEN 100 ELSE 1 END)::BIGINT AS m FROM nation WHERE n_regionkey < 2 GROUP BY n_regionkey"),
    "reduced": ("SELECT (COUNT(*) > 0 AS ?some) (COUNT(DISTINCT ?r) AS ?n) { { SELECT REDUCED ?r { ?x <nation#n_regionkey> ?r } } }", "SELECT count(*) > 0 AS some, count(DISTINCT n_regionkey) AS n FROM nation"),
    "subselect_agg": (
        "SELECT ?k ?o { { SELECT ?c (MAX(?t) AS ?m) { ?x <orders#ref-o_custkey> ?c ; <orders#o_totalprice> ?t } GROUP BY ?c } ?ord <orders#ref-o_custkey> ?c ; <orders#o_totalprice> ?m ; <orders#o_orderkey> ?o . ?c <customer#c_custkey> ?k }",
        "SELECT c_custkey AS k, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT o_custkey AS c, max(o_totalprice) AS m FROM orders GROUP BY 1) ON c = o_custkey AND m = o_totalprice"),
    "having": (
        "SELECT ?k (COUNT(?o) AS ?n) { ?o <orders#ref-o_custkey> ?c . ?c <customer#c_custkey> ?k } GROUP BY ?k HAVING (COUNT(?o) > 14)",
        "SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 14"),
    "exists": (
        "SELECT ?k { ?c <customer#c_custkey> ?k FILTER EXISTS { ?o <orders#ref-o_custkey> ?c ; <orders#o_totalprice> ?t FILTER(?t > 300000.0) } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "not_exists": (
        "SELECT ?k { ?c <customer#c_custkey> ?k FILTER NOT EXISTS { ?o <orders#ref-o_custkey> ?c ; <orders#o_orderpriority> ?pr ; <orders#o_totalprice> ?t FILTER(?t > 400000.0) } }",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "exists_in_or": (
        "SELECT ?k { ?d <documents#doc_id> ?k FILTER(?k < 10 || EXISTS { ?l <labels#ref-doc_id> ?d ; <labels#toxic> 1 }) }",
        "SELECT doc_id AS k FROM documents d WHERE doc_id < 10 OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"),
    "exists_correlated_filter": (
        "SELECT ?k { ?c <customer#c_custkey> ?k ; <customer#c_acctbal> ?b FILTER EXISTS { ?o <orders#ref-o_custkey> ?c ; <orders#o_totalprice> ?t FILTER(?t > ?b * 40) } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"),
    "agg_count_sum_avg": (
        "SELECT ?f (COUNT(*) AS ?n) (SUM(?q) AS ?s) (AVG(?q) AS ?a) { ?l <lineitem#l_returnflag> ?f ; <lineitem#l_quantity> ?q } GROUP BY ?f",
        "SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a FROM lineitem GROUP BY 1"),
    "agg_int": (
        "SELECT ?b (SUM(?s) AS ?t) (xsd:double(AVG(?s)) AS ?a) (MIN(?s) AS ?lo) (MAX(?s) AS ?hi) { ?p <part#p_brand> ?b ; <part#p_size> ?s } GROUP BY ?b",
        "SELECT p_brand AS b, sum(p_size)::BIGINT AS t, avg(p_size) AS a, min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi FROM part GROUP BY 1"),
    "agg_distinct": (
        "SELECT (COUNT(DISTINCT ?u) AS ?n) (SUM(DISTINCT ?u) AS ?s) (COUNT(?t) AS ?c) { ?e <events#user_id> ?u ; <events#event_type> ?t }",
        "SELECT count(DISTINCT user_id) AS n, sum(DISTINCT user_id)::BIGINT AS s, count(event_type) AS c FROM events"),
    "agg_distinct_star": ("SELECT (COUNT(DISTINCT *) AS ?n) { ?e <events#user_id> ?u }", "SELECT count(*) AS n FROM events"),
    "agg_groupconcat": (
        'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=",") AS ?names) { ?x <nation#n_regionkey> ?r ; <nation#n_name> ?n } GROUP BY ?r',
        "SELECT n_regionkey::BIGINT AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "agg_minmax_string": ("SELECT (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) { ?p <part#p_name> ?n }", "SELECT min(p_name) AS lo, max(p_name) AS hi FROM part"),
    "agg_sample": ("SELECT ?r (COUNT(?s) AS ?n) { { SELECT ?r (SAMPLE(?n) AS ?s) { ?x <nation#n_regionkey> ?r ; <nation#n_name> ?n } GROUP BY ?r } } GROUP BY ?r", "SELECT DISTINCT n_regionkey::BIGINT AS r, 1::BIGINT AS n FROM nation"),
    "agg_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) (MAX(?k) AS ?m) { ?x <nation#n_nationkey> ?k FILTER(?k < 0) }", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::BIGINT AS m"),
    "agg_group_expr": ("SELECT ?y (COUNT(*) AS ?n) { ?o <orders#o_orderdate> ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "agg_mixed_types": (
        "SELECT (xsd:double(SUM(?v)) AS ?s) (xsd:double(AVG(?v)) AS ?a) (COUNT(DISTINCT ?v) AS ?n) (xsd:double(MIN(?v)) AS ?lo) (xsd:double(MAX(?v)) AS ?hi) { { ?p <part#p_size> ?v } UNION { ?x <nation#n_nationkey> ?k BIND(?k + 0.5 AS ?v) } UNION { ?x <region#r_regionkey> ?k BIND(xsd:double(?k) / 4 AS ?v) } }",
        "WITH v AS (SELECT p_size::DOUBLE AS v, 'i' AS t FROM part UNION ALL SELECT n_nationkey + 0.5::DOUBLE, 'd' FROM nation UNION ALL SELECT r_regionkey / 4::DOUBLE, 'f' FROM region) SELECT sum(v) AS s, sum(v) / count(*) AS a, count(DISTINCT t || v) AS n, min(v) AS lo, max(v) AS hi FROM v"),
    "agg_mixed_distinct": (
        "SELECT ?b (xsd:double(SUM(DISTINCT ?v)) AS ?s) { ?p <part#p_brand> ?b { ?p <part#p_size> ?v } UNION { ?p <part#p_size> ?k BIND(?k + 0.5 AS ?v) } } GROUP BY ?b",
        "SELECT p_brand AS b, 2 * sum(DISTINCT p_size)::DOUBLE + 0.5 * count(DISTINCT p_size) AS s FROM part GROUP BY 1"),
    "order_mixed_kinds": (
        'SELECT ?i ?s { { ?x <region#r_regionkey> ?v } UNION { ?x <region#r_name> ?v } UNION { ?x <region#r_regionkey> ?k BIND(?x AS ?v) } UNION { ?x <region#r_regionkey> ?k } BIND(STR(?v) AS ?s) BIND(isIRI(?v) AS ?i) } ORDER BY ?v LIMIT 13 OFFSET 3',
        "SELECT i, s FROM (SELECT 0 AS o, NULL AS n, NULL::BOOLEAN AS i, NULL AS s FROM region UNION ALL SELECT 1, NULL, true, 'urn:t:region/' || r_regionkey FROM region UNION ALL SELECT 2, r_regionkey, false, r_regionkey::VARCHAR FROM region UNION ALL SELECT 3, NULL, false, r_name FROM region) ORDER BY o, n, s LIMIT 13 OFFSET 3"),
    "order_limit_offset": (
        "SELECT ?k ?t { ?o <orders#o_orderkey> ?k ; <orders#o_totalprice> ?t } ORDER BY DESC(?t) ?k OFFSET 5 LIMIT 20",
        "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 20 OFFSET 5"),
    "distinct_order": (
        "SELECT DISTINCT ?s { ?o <orders#o_orderstatus> ?s ; <orders#o_orderpriority> ?p } ORDER BY DESC(?s)", "SELECT DISTINCT o_orderstatus AS s FROM orders"),
    "distinct_order_hidden": (
        "SELECT DISTINCT ?u { ?e <events#user_id> ?u ; <events#value> ?v } ORDER BY DESC(?v) ?u LIMIT 10",
        "SELECT user_id AS u FROM events GROUP BY 1 ORDER BY max(value) DESC, u LIMIT 10"),
    "path_plus": (
        "SELECT ?b { <conversations/1-0> <conversations#ref-next>+ ?x . ?x <conversations#turn> ?b }", "SELECT turn AS b FROM conversations WHERE conv_id = 1 AND turn > 0"),
    "path_plus_all": (
        "SELECT (COUNT(*) AS ?n) { ?a <conversations#ref-next>+ ?b }",
        "WITH RECURSIVE r AS (SELECT a.conv_id AS c, a.turn AS s, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 UNION SELECT r.c, r.s, b.turn FROM r JOIN conversations b ON r.c = b.conv_id AND b.turn = r.t + 1) SELECT count(*) AS n FROM r"),
    "path_star": (
        "SELECT ?b { <conversations/1-1> <conversations#ref-next>* ?x . ?x <conversations#turn> ?b }", "SELECT turn AS b FROM conversations WHERE conv_id = 1 AND turn >= 1"),
    "path_opt": ("SELECT (COUNT(*) AS ?n) { ?a <customer#c_custkey> 7 . ?a <customer#ref-c_nationkey>? ?x }", "SELECT count(*) * 2 AS n FROM customer WHERE c_custkey = 7"),
    "path_seq_inverse": (
        "SELECT ?n (COUNT(*) AS ?k) { ?r <region#r_name> ?n . ?r ^<nation#ref-n_regionkey>/^<customer#ref-c_nationkey> ?c } GROUP BY ?n",
        "SELECT r_name AS n, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "path_alt": (
        "SELECT (COUNT(*) AS ?n) { ?l (<lineitem#ref-l_partkey>|<lineitem#ref-l_suppkey>) ?x }", "SELECT 2 * count(*) AS n FROM lineitem"),
    "path_nps": (
        "SELECT ?k (STR(?o) AS ?v) { ?x <nation#n_nationkey> ?k ; !(<nation#n_name>|<nation#n_nationkey>) ?o }",
        "SELECT n_nationkey::BIGINT AS k, unnest([n_regionkey::VARCHAR, 'urn:t:region/' || n_regionkey]) AS v FROM nation"),
    "path_nps_inverse": (
        "SELECT ?k (COUNT(?s) AS ?n) { ?x <nation#n_nationkey> ?k ; !(^<supplier#ref-s_nationkey>) ?s } GROUP BY ?k", "SELECT n_nationkey::BIGINT AS k, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "path_nested_set": (
        "SELECT ?r (COUNT(*) AS ?n) { ?c (<customer#ref-c_nationkey>/<nation#ref-n_regionkey>)? ?y . ?c <customer#c_custkey> ?k . ?y <region#r_regionkey> ?r } GROUP BY ?r",
        "SELECT n_regionkey::BIGINT AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "path_alt_closure": (
        "SELECT ?k (COUNT(*) AS ?n) { ?c <supplier#s_suppkey> ?k ; (<supplier#ref-s_nationkey>|<nation#ref-n_regionkey>)+ ?y } GROUP BY ?k", "SELECT s_suppkey AS k, 2::BIGINT AS n FROM supplier"),
    "path_inverse_composite": (
        "SELECT ?n (COUNT(*) AS ?k) { ?r <region#r_name> ?n . ?r ^(<customer#ref-c_nationkey>/<nation#ref-n_regionkey>) ?c } GROUP BY ?n",
        "SELECT r_name AS n, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "path_endpoints": (
        "SELECT ?k ?hit { ?x <nation#n_nationkey> ?k OPTIONAL { ?x <nation#ref-n_regionkey>+ <region/1> BIND(true AS ?hit) } }", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey = 1 THEN true END AS hit FROM nation"),
    "path_absent_constant": ("SELECT (COUNT(*) AS ?n) { <urn:x:absent> <nation#ref-n_regionkey>* ?x }", "SELECT 1::BIGINT AS n"),
    "path_not_a_node": ("SELECT (COUNT(?y) AS ?n) { VALUES ?x { <urn:x:absent> <region/1> } ?x <nation#ref-n_regionkey>* ?y }", "SELECT 1::BIGINT AS n"),
    "path_same_variable": ("SELECT (COUNT(*) AS ?n) { ?x <nation#n_nationkey> ?k . ?x (<nation#ref-n_regionkey>/^<nation#ref-n_regionkey>) ?x }", "SELECT count(*) AS n FROM nation"),
    "path_star_nodes": ("SELECT (COUNT(*) AS ?n) { ?x <region#r_regionkey> ?k . ?x <nation#ref-n_regionkey>* ?y }", "SELECT count(*) AS n FROM region"),
    "fn_str": (
        'SELECT ?k (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (STRLEN(?n) AS ?len) (SUBSTR(?n, 2, 3) AS ?sub) (CONCAT(?n, "-", STR(?k)) AS ?c) (CONTAINS(?n, "A") AS ?has) (STRSTARTS(?n, "A") AS ?st) (STRENDS(?n, "A") AS ?en) (STRBEFORE(?n, "A") AS ?be) (STRAFTER(?n, "A") AS ?af) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n }',
        "SELECT n_nationkey::BIGINT AS k, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS len, substr(n_name, 2, 3) AS sub, n_name || '-' || n_nationkey AS c, contains(n_name, 'A') AS has, starts_with(n_name, 'A') AS st, ends_with(n_name, 'A') AS en, CASE WHEN contains(n_name, 'A') THEN split_part(n_name, 'A', 1) ELSE '' END AS be, CASE WHEN contains(n_name, 'A') THEN substr(n_name, position('A' IN n_name) + 1) ELSE '' END AS af FROM nation"),
    "fn_num": (
        "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) { ?s <supplier#s_suppkey> ?k ; <supplier#s_acctbal> ?b }",
        "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r FROM supplier"),
    "fn_time": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) { ?e <events#event_id> ?k ; <events#ts> ?d }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi FROM events"),
    "fn_hash": (
        "SELECT ?k (MD5(?t) AS ?m) (SHA1(?t) AS ?s1) (SHA256(?t) AS ?s2) { ?d <documents#doc_id> ?k ; <documents#text> ?t }", "SELECT doc_id AS k, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2 FROM documents"),
    "fn_regex": ('SELECT ?k { ?p <part#p_partkey> ?k ; <part#p_name> ?n FILTER REGEX(?n, "^[A-M].* (widget|bolt)$", "i") }', "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, '^[A-M].* (widget|bolt)$', 'i')"),
    "regex_column": (
        'SELECT ?k ?m (REGEX(?n, ?m) AS ?hit) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n BIND(IF(?k < 5, "(", CONCAT("^.", SUBSTR(?n, 2, 1), "|z{2}")) AS ?m) }',
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 5 THEN '(' ELSE '^.' || substr(n_name, 2, 1) || '|z{2}' END AS m, CASE WHEN n_nationkey >= 5 THEN true END AS hit FROM nation"),
    "regex_flags": (
        'SELECT ?k (REGEX(?n, "a", ?f) AS ?hit) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n BIND(IF(?k < 10, "i", IF(?k < 20, "", "z")) AS ?f) }',
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 10 THEN contains(lower(n_name), 'a') WHEN n_nationkey < 20 THEN contains(n_name, 'a') END AS hit FROM nation"),
    "replace_column": (
        'SELECT ?k (REPLACE(?n, SUBSTR(?n, 1, 1), "<$0>") AS ?a) (REPLACE(?n, "([A-Z])(.)", ?to, "i") AS ?b) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n BIND(IF(?k < 9, "$2$1", "${1}-$$") AS ?to) }',
        r"SELECT n_nationkey::BIGINT AS k, replace(n_name, substr(n_name, 1, 1), '<' || substr(n_name, 1, 1) || '>') AS a, CASE WHEN n_nationkey < 9 THEN regexp_replace(n_name, '([A-Z])(.)', '\2\1', 'gi') ELSE regexp_replace(n_name, '([A-Z])(.)', '\1-$', 'gi') END AS b FROM nation"),
    "fn_language": (
        'SELECT ?k (LANG(?t) AS ?l) (LANGDIR(?w) AS ?d) (hasLANG(?t) AS ?h) (hasLANGDIR(?w) AS ?hd) (hasLANGDIR(?t) AS ?no) (LANGMATCHES(LANG(?t), "en") AS ?m) (STR(?t) AS ?s) (STR(DATATYPE(?w)) AS ?dt) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n BIND(STRLANG(?n, IF(?k < 7, "en-GB", "fr")) AS ?t) BIND(STRLANGDIR(?n, "ar", "rtl") AS ?w) }',
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 7 THEN 'en-gb' ELSE 'fr' END AS l, 'rtl' AS d, true AS h, true AS hd, false AS no, n_nationkey < 7 AS m, n_name AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#dirLangString' AS dt FROM nation"),
    "fn_term": (
        'SELECT ?k (sameTerm(?i, ?x) AS ?same) (sameTerm(?k, ?n) AS ?differ) (isURI(?i) AS ?u) (STR(URI(CONCAT("urn:y:", ?n))) AS ?y) (STR(STRDT(STR(?k), xsd:integer) + 1) AS ?p) (STR(DATATYPE(STRDT(?n, <urn:x:d>))) AS ?dt) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n BIND(IRI(CONCAT("urn:t:nation/", STR(?k))) AS ?i) }',
        "SELECT n_nationkey::BIGINT AS k, true AS same, false AS differ, true AS u, 'urn:y:' || n_name AS y, (n_nationkey + 1)::VARCHAR AS p, 'urn:x:d' AS dt FROM nation"),
    "fn_triple": (
        'SELECT ?k (isTRIPLE(?t) AS ?i) (isTRIPLE(?k) AS ?no) (STR(SUBJECT(?t)) AS ?s) (STR(PREDICATE(?t)) AS ?p) (STR(OBJECT(?t)) AS ?o) (sameTerm(?t, TRIPLE(?x, <urn:x:p>, ?n)) AS ?same) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n BIND(<<( ?x <urn:x:p> ?n )>> AS ?t) }',
        "SELECT n_nationkey::BIGINT AS k, true AS i, false AS no, 'urn:t:nation/' || n_nationkey AS s, 'urn:x:p' AS p, n_name AS o, true AS same FROM nation"),
    "fn_hash_long": (
        "SELECT ?k (STRLEN(SHA384(?t)) AS ?a) (STRLEN(SHA512(?t)) AS ?b) (SHA384(?t) = SHA384(CONCAT(?t, \"\")) AS ?same) (SUBSTR(SHA512(\"\"), 1, 16) AS ?e) (SUBSTR(SHA384(\"\"), 1, 16) AS ?f) { ?d <documents#doc_id> ?k ; <documents#text> ?t }",
        "SELECT doc_id AS k, 96::BIGINT AS a, 128::BIGINT AS b, true AS same, 'cf83e1357eefb8bd' AS e, '38b060a751ac9638' AS f FROM documents WHERE text IS NOT NULL"),
    "fn_zone": (
        'SELECT ?k (TZ(?t) AS ?z) (STR(TIMEZONE(?t)) AS ?d) (xsd:double(SECONDS(?t)) AS ?s) (DATATYPE(NOW()) = xsd:dateTime AS ?now) { ?x <nation#n_nationkey> ?k BIND(STRDT(CONCAT("2020-02-03T04:05:", STR(10 + ?k), ".5", IF(?k < 9, "Z", IF(?k < 17, "+05:30", "-01:00"))), xsd:dateTime) AS ?t) }',
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 9 THEN 'Z' WHEN n_nationkey < 17 THEN '+05:30' ELSE '-01:00' END AS z, CASE WHEN n_nationkey < 9 THEN 'PT0S' WHEN n_nationkey < 17 THEN 'PT5H30M' ELSE '-PT1H' END AS d, 10.5::DOUBLE + n_nationkey AS s, true AS now FROM nation"),
    "fn_random": (
        "SELECT (COUNT(DISTINCT ?u) AS ?uuids) (COUNT(DISTINCT ?s) AS ?texts) (COUNT(DISTINCT ?b) AS ?blanks) (MIN(?ok) AS ?fine) { ?x <customer#c_custkey> ?k BIND(UUID() AS ?u) BIND(STRUUID() AS ?s) BIND(BNODE() AS ?b) BIND(RAND() AS ?r) BIND(IF(?r >= 0 && ?r < 1 && isIRI(?u) && isBLANK(?b) && STRLEN(?s) = 36, 1, 0) AS ?ok) }",
        "SELECT count(*) AS uuids, count(*) AS texts, count(*) AS blanks, 1::BIGINT AS fine FROM customer"),
    "fn_unary": (
        "SELECT ?k (-?b AS ?m) (+?k AS ?p) (-(?k - 3) AS ?d) { ?s <supplier#s_suppkey> ?k ; <supplier#s_acctbal> ?b }", "SELECT s_suppkey AS k, -s_acctbal AS m, s_suppkey AS p, 3 - s_suppkey AS d FROM supplier"),
    "cast_other": (
        'SELECT ?k (xsd:double(xsd:decimal(STR(?k)) / 4) AS ?q) (YEAR(xsd:dateTime(CONCAT(STR(2000 + ?k), "-05-06T07:08:09Z"))) AS ?y) (xsd:float(?k) = ?k AS ?f) (STR(COALESCE(xsd:dateTime(?n), "none")) AS ?none) (COALESCE(xsd:integer(?n), -1) AS ?bad) (COALESCE(xsd:duration(?n), "none") AS ?other) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n }',
        "SELECT n_nationkey::BIGINT AS k, n_nationkey / 4 AS q, (2000 + n_nationkey)::BIGINT AS y, true AS f, 'none' AS none, (-1)::BIGINT AS bad, 'none' AS other FROM nation"),
    "fn_replace": ('SELECT ?k (REPLACE(?n, "([0-9])[0-9]*", "<$1>") AS ?r) { ?p <part#p_partkey> ?k ; <part#p_name> ?n }', r"SELECT p_partkey AS k, regexp_replace(p_name, '([0-9])[0-9]*', '<\1>', 'g') AS r FROM part"),
    "fn_if_coalesce": (
        'SELECT ?k (IF(?q = 1, "good", "bad") AS ?w) (COALESCE(?q, -1) AS ?c) { ?d <documents#doc_id> ?k OPTIONAL { ?l <labels#ref-doc_id> ?d ; <labels#quality> ?q } }',
        "SELECT d.doc_id AS k, CASE WHEN quality = 1 THEN 'good' WHEN quality <> 1 THEN 'bad' END AS w, coalesce(quality, -1)::BIGINT AS c FROM documents d LEFT JOIN labels USING (doc_id)"),
    "fn_kind": (
        "SELECT (isIRI(?c) AS ?i) (isLiteral(?k) AS ?l) (isNumeric(?k) AS ?n) (isBlank(?c) AS ?b) (STR(DATATYPE(?k)) AS ?d) (STR(?c) AS ?s) { ?c <nation#n_nationkey> ?k }",
        "SELECT true AS i, true AS l, true AS n, false AS b, 'http://www.w3.org/2001/XMLSchema#integer' AS d, 'urn:t:nation/' || n_nationkey AS s FROM nation"),
    "fn_uri": ('SELECT ?k (ENCODE_FOR_URI(CONCAT(?n, " ~*é")) AS ?u) { ?x <nation#n_nationkey> ?k ; <nation#n_name> ?n }', "SELECT n_nationkey::BIGINT AS k, replace(n_name, ' ', '%20') || '%20~%2A%C3%A9' AS u FROM nation"),
    "fn_decimal": ("SELECT ?k (xsd:double(?s / 7) AS ?d) { ?p <part#p_partkey> ?k ; <part#p_size> ?s }", "SELECT p_partkey AS k, p_size / 7 AS d FROM part"),
    "cast": (
        'SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:boolean(?k) AS ?t) (xsd:double(STR(?k)) AS ?d) { ?x <supplier#s_suppkey> ?k ; <supplier#s_acctbal> ?b }',
        "SELECT s_suppkey AS k, trunc(s_acctbal)::BIGINT AS i, s_suppkey::VARCHAR AS s, s_suppkey <> 0 AS t, s_suppkey::DOUBLE AS d FROM supplier"),
    "ask": ("ASK { ?o <orders#o_totalprice> ?t FILTER(?t > 100000.0) }", "SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 100000"),
    "construct": (
        "CONSTRUCT { ?c <urn:x:in> ?r } WHERE { ?c <customer#ref-c_nationkey> ?n . ?n <nation#ref-n_regionkey> ?r }",
        "SELECT DISTINCT '<urn:t:customer/' || c_custkey || '>' AS s, '<urn:x:in>' AS p, '<urn:t:region/' || n_regionkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "describe": (
        "DESCRIBE <region/2>",
        "SELECT '<urn:t:region/2>' AS s, unnest(['<urn:t:region#r_regionkey>', '<urn:t:region#r_name>']) AS p, unnest(['\"2\"^^<http://www.w3.org/2001/XMLSchema#integer>', '\"' || r_name || '\"']) AS o FROM region WHERE r_regionkey = 2"),
}


def expanded(text: str) -> str:
    """The prefixes of the table graph: <nation#n_name> is <urn:t:nation#n_name>."""
    text = re.sub(r"<([a-z]+[#/][A-Za-z0-9_\-]+)>", r"<urn:t:\1>", text)
    return "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + text


def _runner(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(graph_of(spark, sf_dir), expanded(text)).df

    return run


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quads of two small tables, in order."""
    return graph_of(spark, sf_dir, ("nation", "region")).quads().orderBy("s", "p", "o").coalesce(1)


def _updated(request: str, text: str):
    """A query over a store of the small tables' quads after an update."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
        store.load(_nations(spark, sf_dir))
        update(store, expanded(request))
        return query(store.snapshot(), expanded(text)).df

    return run


def _piped(make):
    return lambda spark, sf_dir: make(Stream.of(_nations(spark, sf_dir)))


def _number(spark_of, n: int) -> DataFrame:
    return spark_of.sparkSession.createDataFrame([(n,)], "n long")


def _shared(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _round_trip(syntax: str, graph: str | None = None, **options):
    """The small tables' quads, written in a syntax and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _shared(spark, syntax)
        rdf.write(_nations(spark, sf_dir).withColumn("g", F.lit(graph).cast("string")), path, syntax, **options)
        back = rdf.read(spark, path, syntax)
        return back.where(F.col("g").eqNullSafe(F.lit(graph))).select("s", "p", "o")

    return run


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD of a written file into a graph."""
    path, store = _shared(spark, "load"), Store(spark, _shared(spark, "store"))
    rdf.write(_nations(spark, sf_dir), path, "nt")
    update(store, f"LOAD <{path}> INTO GRAPH <urn:x:g>", loader=lambda source: rdf.read(spark, source, "nt"))
    return query(store.snapshot(), "SELECT (STR(?g) AS ?graph) (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g").df


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quads before and after compaction of a store with deletes, and whether it verifies."""
    store = Store(spark, _shared(spark, "store"))
    store.load(_nations(spark, sf_dir))
    update(store, expanded("DELETE WHERE { ?n <nation#n_name> ?x }"))
    before = store.quads().count()
    store.compact()
    store.collect_garbage()
    return spark.createDataFrame([(store.verify(), before, store.quads().count())], "sound boolean, n long, after long")


def _piped_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline that reads a file, cuts it and writes another, as it is read back."""
    source, out = _shared(spark, "pipe"), _shared(spark, "pipe")
    rdf.write(_nations(spark, sf_dir), source, "nq")
    rdf.write(Stream.of(rdf.read(spark, source, "nq").orderBy("s", "p", "o").coalesce(1)).skip(3).head(47).df, out, "nq")
    return rdf.read(spark, out, "nq").select("s", "p", "o")


_QUADS = """WITH k AS (SELECT '<urn:t:nation/' || n_nationkey || '>' AS s, unnest(['<urn:t:nation#n_name>', '<urn:t:nation#n_nationkey>', '<urn:t:nation#n_regionkey>', '<urn:t:nation#ref-n_regionkey>']) AS p,
  unnest(['"' || n_name || '"', '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '"' || n_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '<urn:t:region/' || n_regionkey || '>']) AS o FROM nation
 UNION ALL SELECT '<urn:t:region/' || r_regionkey || '>', unnest(['<urn:t:region#r_name>', '<urn:t:region#r_regionkey>']), unnest(['"' || r_name || '"', '"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>']) FROM region),
n AS (SELECT *, row_number() OVER (ORDER BY s, p, o) - 1 AS ord, count(*) OVER () AS total FROM k)"""

OTHER: dict[str, tuple] = {
    "update_insert_where": (
        _updated("INSERT { ?n <urn:x:in> ?name } WHERE { ?n <nation#ref-n_regionkey> ?r . ?r <region#r_name> ?name }", "SELECT (STR(?n) AS ?s) (STR(?name) AS ?region) { ?n <urn:x:in> ?name }"),
        "SELECT 'urn:t:nation/' || n_nationkey AS s, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "update_delete_where": (
        _updated("DELETE WHERE { ?n <nation#ref-n_regionkey> <region/1> ; <nation#n_name> ?x }", "SELECT (COUNT(*) AS ?n) { ?s ?p ?o }"),
        "SELECT (SELECT 4 * count(*) - 2 * count_if(n_regionkey = 1) FROM nation)::BIGINT + (SELECT 2 * count(*) FROM region)::BIGINT AS n"),
    "update_modify": (
        _updated("DELETE { ?n <nation#n_name> ?x } INSERT { ?n <nation#n_name> ?u } WHERE { ?n <nation#n_name> ?x ; <nation#n_nationkey> ?k FILTER(?k < 5) BIND(LCASE(?x) AS ?u) }", "SELECT (STR(?x) AS ?name) { ?n <nation#n_name> ?x }"),
        "SELECT CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS name FROM nation"),
    "update_move": (
        _updated("MOVE DEFAULT TO <urn:x:g> ; INSERT DATA { <urn:x:a> <urn:x:p> 1 } ; DELETE DATA { GRAPH <urn:x:g> { <region/0> <region#r_regionkey> 0 } }", "SELECT ?g (COUNT(*) AS ?n) { { ?s ?p ?o BIND('default' AS ?g) } UNION { GRAPH ?h { ?s ?p ?o } BIND(STR(?h) AS ?g) } } GROUP BY ?g"),
        "SELECT * FROM (VALUES ('default', 1::BIGINT), ('urn:x:g', (SELECT 4 * count(*) FROM nation)::BIGINT + (SELECT 2 * count(*) FROM region)::BIGINT - 1)) v(g, n)"),
    "update_triple_term_pattern": (
        _updated("INSERT { ?r <urn:x:says> <<( ?n <nation#n_name> ?x )>> } WHERE { ?n <nation#ref-n_regionkey> ?r ; <nation#n_name> ?x }", "SELECT (STR(?r) AS ?who) (STR(?n) AS ?s) (STR(?x) AS ?name) { ?r <urn:x:says> <<( ?n <nation#n_name> ?x )>> }"),
        "SELECT 'urn:t:region/' || n_regionkey AS who, 'urn:t:nation/' || n_nationkey AS s, n_name AS name FROM nation"),
    "update_clear": (
        _updated("INSERT { GRAPH <urn:x:g> { ?s <urn:x:p> ?o } GRAPH <urn:x:h> { ?s <urn:x:q> ?o } } WHERE { ?s <nation#n_name> ?o } ; CLEAR GRAPH <urn:x:g> ; CREATE SILENT GRAPH <urn:x:new> ; DROP DEFAULT", "SELECT (STR(?g) AS ?graph) (COUNT(*) AS ?n) { { ?s ?p ?o BIND('default' AS ?g) } UNION { GRAPH ?g { ?s ?p ?o } } } GROUP BY ?g"),
        "SELECT 'urn:x:h' AS graph, count(*) AS n FROM nation"),
    "update_add_copy": (
        _updated("INSERT DATA { GRAPH <urn:x:b> { <urn:x:a> <urn:x:p> 1 } } ; ADD DEFAULT TO <urn:x:a> ; COPY DEFAULT TO <urn:x:b> ; ADD SILENT <urn:x:none> TO <urn:x:b>", "SELECT (STR(?g) AS ?graph) (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g"),
        "SELECT unnest(['urn:x:a', 'urn:x:b']) AS graph, (SELECT 4 * count(*) FROM nation)::BIGINT + (SELECT 2 * count(*) FROM region)::BIGINT AS n"),
    "update_load": (_loaded, _QUADS + " SELECT 'urn:x:g' AS graph, count(*) AS n FROM n"),
    "store_compact_verify": (_compacted, _QUADS + " SELECT true AS sound, count(*) - (SELECT count(*) FROM nation) AS n, count(*) - (SELECT count(*) FROM nation) AS after FROM n"),
    "io_ntriples": (_round_trip("nt"), _QUADS + " SELECT s, p, o FROM n"),
    "io_nquads": (_round_trip("nq"), _QUADS + " SELECT s, p, o FROM n"),
    "io_turtle": (_round_trip("ttl", prefixes={"t": "urn:t:", "n": "urn:t:nation#"}), _QUADS + " SELECT s, p, o FROM n"),
    "io_trig": (_round_trip("trig", graph="<urn:x:g>"), _QUADS + " SELECT s, p, o FROM n"),
    "io_rdfxml": (_round_trip("rdfxml"), _QUADS + " SELECT s, p, o FROM n"),
    "io_jsonld": (_round_trip("jsonld", graph="<urn:x:g>"), _QUADS + " SELECT s, p, o FROM n"),
    "pipe_read_write": (_piped_file, _QUADS + " SELECT s, p, o FROM n WHERE ord >= 3 AND ord < 50"),
    "pipe_head": (_piped(lambda s: s.head(10).df.select("s", "p", "o")), _QUADS + " SELECT s, p, o FROM n WHERE ord < 10"),
    "pipe_skip": (_piped(lambda s: s.skip(95).df.select("s", "p", "o")), _QUADS + " SELECT s, p, o FROM n WHERE ord >= 95"),
    "pipe_tail": (_piped(lambda s: s.tail(7).df.select("s", "p", "o")), _QUADS + " SELECT s, p, o FROM n WHERE ord >= total - 7"),
    "pipe_head_subjects": (_piped(lambda s: s.head(3, "subjects").df.select("s", "p", "o")), _QUADS + ", d AS (SELECT *, dense_rank() OVER (ORDER BY s) AS r FROM n) SELECT s, p, o FROM d WHERE r <= 3"),
    "pipe_tree": (_piped(lambda s: Stream.concat(s, s.head(5)).tree().df.select("s", "p", "o")), _QUADS + " SELECT s, p, o FROM n"),
    "pipe_concat": (_piped(lambda s: Stream.concat(s.head(2), s.tail(2)).df.select("s", "ord")), _QUADS + " SELECT s, ord FROM n WHERE ord < 2 UNION ALL SELECT s, ord - total + 4 FROM n WHERE ord >= total - 2"),
    "pipe_merge_count": (_piped(lambda s: _number(s.df, Stream.merge(s, s).count())), _QUADS + " SELECT 2 * count(*) AS n FROM n"),
    "pipe_distinct_predicates": (_piped(lambda s: _number(s.df, s.distinct("predicates"))), _QUADS + " SELECT count(DISTINCT p) AS n FROM n"),
}

QUERIES = {f"sparql_{name}": _runner(text) for name, (text, _) in SPARQL.items()} | {name: f for name, (f, _) in OTHER.items()}
ORACLE = {f"sparql_{name}": sql for name, (_, sql) in SPARQL.items()} | {name: sql for name, (_, sql) in OTHER.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by market segment."""
    text = "SELECT ?seg (COUNT(*) AS ?n) { ?o <orders#ref-o_custkey> ?c . ?c <customer#c_mktsegment> ?seg } GROUP BY ?seg ORDER BY ?seg"
    return _runner(text)(spark, sf_dir)

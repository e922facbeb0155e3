"""Queries over the test tables seen as a graph, and the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import RDF_TYPE, STRING, XSD
from graphloom.operators import access, canon, documents, operations, rules, shapes, sync, validate
from graphloom.operators import index as search_index
from graphloom.operators.profile import Profile, collapse, doc_profile, load
from graphloom.plans import compiler
from graphloom.plans.sparql import Node
from graphloom.sources import rdf
from graphloom.sources.quads import TRIPLE, TableSource, UnionSource, difference, prefix_map, set_of, union
from graphloom.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
P = prefix_map()


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def graph(spark: SparkSession, sf_dir: str, *tables: str) -> TableSource:
    return TableSource(spark, sf_dir, tables or None)


def run(source, text: str, **kinds: str) -> DataFrame:
    return compiler.values(compiler.select(source, text, P), **kinds)


PROFILE = """
{ uri: "urn:profile:sales", prefixes: {customer: "urn:customer#", orders: "urn:orders#", nation: "urn:nation#", t: "urn:"},  // the test tables
  types: {
    Nation: {rules: {rdfType: "urn:nation"}, attributes: {name: {uri: "nation:n_name", rules: {range: {datatype: "xsd:string"}, minCardinality: 1, maxCardinality: 1}}}},
    Customer: {rules: {rdfType: "urn:customer"}, attributes: {
      name: {uri: "customer:c_name", rules: {range: {datatype: "xsd:string"}, minCardinality: 1, maxCardinality: 1}},
      segment: {uri: "customer:c_mktsegment", rules: {range: {datatype: "xsd:string"}, maxCardinality: 1}},
      nation: {uri: "customer:c_nationkey", rules: {range: {classId: "Nation"}, maxCardinality: 1}},
      orders: {uri: "orders:o_custkey", inverse: true, rules: {range: {classId: "Order"}, maxCardinality: 12}}, }},
    Order: {rules: {rdfType: "urn:orders"}, attributes: {
      status: {uri: "orders:o_orderstatus", rules: {range: {or: [{literalValue: "F"}, {literalValue: "O"}]}, maxCardinality: 1}},
      customer: {uri: "orders:o_custkey", rules: {range: {classId: "Customer"}, minCardinality: 1, maxCardinality: 1}}, }},
  }, }
"""


def profile() -> Profile:
    return load(PROFILE)


# A: algebra


@query("""select concat('urn:customer:', c_custkey) as c, c_name as name, o_totalprice as total
from customer join orders on o_custkey = c_custkey join nation on n_nationkey = c_nationkey where n_name = (select min(n_name) from nation) and o_totalprice > 100000""")
def bgp_customer_orders(spark, sf_dir):
    src = graph(spark, sf_dir, "nation", "customer", "orders")
    first = src.table("nation").agg(F.min("n_name")).first()[0]  # one value
    return run(src, f'SELECT ?c ?name ?total WHERE {{ ?o orders:o_custkey ?c ; orders:o_totalprice ?total . ?c customer:c_name ?name ; customer:c_nationkey ?n . ?n nation:n_name "{first}" FILTER(?total > 100000) }}', total="double")


@query("select concat('urn:nation:', n_nationkey) as s, n_name as o from nation")
def scan_pattern(spark, sf_dir):
    return run(graph(spark, sf_dir, "nation"), "SELECT ?s ?o WHERE { ?s nation:n_name ?o }")


@query("""select 'urn:graph:nation' as g, count(*) as n from (select n_nationkey from nation where n_name is not null union all select n_nationkey from nation where n_regionkey is not null union all select n_nationkey from nation where n_nationkey is not null union all select n_nationkey from nation)
union all select 'urn:graph:region', count(*) from (select r_regionkey from region where r_name is not null union all select r_regionkey from region where r_regionkey is not null union all select r_regionkey from region)""")
def named_graph_counts(spark, sf_dir):
    src = TableSource(spark, sf_dir, ("nation", "region"), graph=lambda t: F.lit(f"urn:graph:{t}"))
    return run(src, "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", n="long")


@query("select concat('urn:region:', r_regionkey) as s, r_name as name from region")
def graph_scan_and_relaxed(spark, sf_dir):
    src = TableSource(spark, sf_dir, ("nation", "region"), graph=lambda t: F.lit(f"urn:graph:{t}"))
    return run(src, "SELECT ?s ?name WHERE { GRAPH <urn:graph:region> { ?s region:r_name ?name } ?s a ?type }")


@query("""select concat('urn:customer:', c_custkey) as c, 'urn:orders:' || o_orderkey as o, o_orderpriority as p
from customer left join orders on o_custkey = c_custkey and o_orderpriority like '1%'""")
def optional_customer_orders(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "orders")
    return run(src, 'SELECT ?c ?o ?p WHERE { ?c customer:c_name ?n OPTIONAL { ?o orders:o_custkey ?c ; orders:o_orderpriority ?p FILTER(STRSTARTS(?p, "1")) } }')


@query("""select concat('urn:customer:', c_custkey) as c, coalesce(nation.n_name, r_name) as x from customer left join nation on nation.n_nationkey = c_nationkey and c_acctbal > 5000 join nation m on m.n_nationkey = c_nationkey join region on r_regionkey = m.n_regionkey""")
def optional_coalesce_bound(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "nation", "region")
    return run(src, "SELECT ?c (COALESCE(?n, ?r) AS ?x) WHERE { ?c customer:c_nationkey ?k ; customer:c_acctbal ?b . ?k nation:n_regionkey/region:r_name ?r OPTIONAL { ?k nation:n_name ?n FILTER(?b > 5000) } }")


@query("""select concat('urn:customer:', c_custkey) as c, concat('urn:region:', r_regionkey) as r from customer left join nation on n_nationkey = c_nationkey and c_acctbal > 5000
join region on (n_regionkey is null or n_regionkey = r_regionkey)""")
def unbound_join_compatibility(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "nation", "region")
    return run(src, "SELECT ?c ?r WHERE { { SELECT ?c ?r WHERE { ?c customer:c_nationkey ?k ; customer:c_acctbal ?b OPTIONAL { ?k nation:n_regionkey ?r FILTER(?b > 5000) } } } ?r region:r_name ?name }")


@query("select concat('urn:customer:', c_custkey) as c from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def not_exists_customers_without_orders(spark, sf_dir):
    return run(graph(spark, sf_dir, "customer", "orders"), "SELECT ?c WHERE { ?c a <urn:customer> FILTER NOT EXISTS { ?o orders:o_custkey ?c } }")


@query("select concat('urn:customer:', c_custkey) as c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def exists_customers_with_large_orders(spark, sf_dir):
    return run(graph(spark, sf_dir, "customer", "orders"), "SELECT ?c WHERE { ?c a <urn:customer> FILTER EXISTS { ?o orders:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 400000) } }")


@query("""select concat('urn:part:', a.l_partkey) as p, concat('urn:part:', b.l_partkey) as q, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey
where a.l_returnflag = 'R' and b.l_returnflag = 'R' group by 1, 2""")
def theta_pairs_same_order(spark, sf_dir):
    src = graph(spark, sf_dir, "lineitem")
    return run(src, 'SELECT ?p ?q (COUNT(*) AS ?n) WHERE { ?a lineitem:l_orderkey ?o ; lineitem:l_partkey ?p ; lineitem:l_returnflag "R" . ?b lineitem:l_orderkey ?o ; lineitem:l_partkey ?q ; lineitem:l_returnflag "R" FILTER(?p != ?q) } GROUP BY ?p ?q', n="long")


@query("select 'urn:' || t as type, n from (select 'nation' as t, count(*) as n from nation union all select 'region', count(*) from region union all select 'supplier', count(*) from supplier)")
def instances_per_type(spark, sf_dir):
    src = graph(spark, sf_dir, "nation", "region", "supplier")
    return run(src, "SELECT ?type (COUNT(DISTINCT ?s) AS ?n) WHERE { ?s a ?type } GROUP BY ?type", n="long")


@query("select distinct l_returnflag as f, l_linestatus as s from lineitem")
def distinct_flags(spark, sf_dir):
    return run(graph(spark, sf_dir, "lineitem"), "SELECT DISTINCT ?f ?s WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?s }")


@query("select concat('urn:customer:', o_custkey) as c, count(*) as n, max(o_totalprice) as top, sum(o_totalprice) as total from orders group by 1 having count(*) > 10")
def having_many_orders(spark, sf_dir):
    df = run(graph(spark, sf_dir, "orders"), "SELECT ?c (COUNT(?o) AS ?n) (MAX(?t) AS ?top) (SUM(?t) AS ?total) WHERE { ?o orders:o_custkey ?c ; orders:o_totalprice ?t } GROUP BY ?c HAVING(COUNT(?o) > 10)", n="long", top="double", total="double")
    return df.withColumn("total", F.round("total", 2))


SQL["having_many_orders"] = SQL["having_many_orders"].replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)")


@query("select concat('urn:customer:', c_custkey) as x, c_name as name from customer union all select concat('urn:supplier:', s_suppkey), s_name from supplier")
def union_iris(spark, sf_dir):
    return run(graph(spark, sf_dir, "customer", "supplier"), "SELECT ?x ?name WHERE { { ?x customer:c_name ?name } UNION { ?x supplier:s_name ?name } }")


@query("select concat('urn:part:', p_partkey) as p, p_size as size, upper(p_brand) as brand, length(p_name) as len from part where p_size in (1, 5, 9) and regexp_matches(p_brand, '[1-3]') and not starts_with(p_type, 'S')")
def filter_functions(spark, sf_dir):
    text = 'SELECT ?p ?size (UCASE(?b) AS ?brand) (STRLEN(?n) AS ?len) WHERE { ?p part:p_size ?size ; part:p_brand ?b ; part:p_name ?n ; part:p_type ?t FILTER(?size IN (1, 5, 9) && REGEX(?b, "[1-3]") && !STRSTARTS(?t, "S")) }'
    return run(graph(spark, sf_dir, "part"), text, size="int", len="int")


@query("""select lang as lang, count(*) as n, cast(count(*) filter (lang <> '') as bigint) as tagged from documents group by lang""")
def language_and_datatype(spark, sf_dir):
    text = "SELECT ?lang (COUNT(?t) AS ?n) (COUNT(?x) AS ?tagged) WHERE { ?d documents:text ?t BIND(LANG(?t) AS ?l) BIND(STR(?l) AS ?lang) BIND(IF(DATATYPE(?t) = rdf:langString && ISLITERAL(?t), ?d, ?none) AS ?x) } GROUP BY ?lang"
    return run(graph(spark, sf_dir, "documents"), text, n="long", tagged="long")


@query("select concat('urn:orders:', o_orderkey) as o, o_totalprice as t from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def page_ordered(spark, sf_dir):
    df = run(graph(spark, sf_dir, "orders"), "SELECT ?o ?t WHERE { ?o orders:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 25 OFFSET 50", t="double")
    return df


@query("select concat('urn:lineitem:', l_orderkey, '-', l_linenumber) as l, n_name as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def path_nation_of_lineitem(spark, sf_dir):
    src = graph(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    return run(src, "SELECT ?l ?n WHERE { ?l lineitem:l_orderkey/orders:o_custkey/customer:c_nationkey/nation:n_name ?n }")


@query("select concat('urn:customer:', c_custkey) as c, (c_acctbal > 0 and c_mktsegment = 'BUILDING') as holds from customer")
def ask_each_customer(spark, sf_dir):
    src = graph(spark, sf_dir, "customer")
    each = src.table("customer").select(terms.iri(src.subject("customer")).alias("c"))
    held = compiler.ask_each(src, 'ASK { ?c customer:c_acctbal ?b ; customer:c_mktsegment "BUILDING" FILTER(?b > 0) }', each, P)
    return held.select(F.col("c.value").alias("c"), "holds")


@query("select concat('urn:customer:', c_custkey) as c, name from (values (1), (5), (9)) t(k) join customer on c_custkey = k, lateral (select c_name as name)")
def values_bindings(spark, sf_dir):
    return run(graph(spark, sf_dir, "customer"), "SELECT ?c ?name WHERE { VALUES ?c { <urn:customer:1> <urn:customer:5> <urn:customer:9> } ?c customer:c_name ?name }")


# sets, updates, deltas

TRIPLE_SQL = "concat('urn:nation:', n_nationkey) as s, 'urn:in' as p, concat('urn:region:', n_regionkey) as o"


@query(f"select {TRIPLE_SQL} from nation union select concat('urn:region:', n_regionkey), 'urn:has', concat('urn:nation:', n_nationkey) from nation")
def construct_graph(spark, sf_dir):
    g = compiler.construct(graph(spark, sf_dir, "nation"), "CONSTRUCT { ?n <urn:in> ?r . ?r <urn:has> ?n } WHERE { ?n nation:n_regionkey ?r }", P)
    return g.select("s", "p", "o")


@query("""select 'add' as action, concat('urn:customer:', c_custkey) as s, cast(c_acctbal + 1 as varchar) as o from customer where c_acctbal < 0
union all select 'remove', concat('urn:customer:', c_custkey), cast(c_acctbal as varchar) from customer where c_acctbal < 0""")
def delta_add_remove(spark, sf_dir):
    src = graph(spark, sf_dir, "customer")
    old = src.scan(["urn:customer#c_acctbal"])
    b = F.col("o").cast("double")
    new = old.withColumn("o", F.when(b < 0, (b + 1).cast("string")).otherwise(F.col("o")))
    return sync.delta(old, new).select("action", "s", F.col("o").cast("double").alias("o"))


SQL["delta_add_remove"] = SQL["delta_add_remove"].replace("cast(c_acctbal + 1 as varchar)", "c_acctbal + 1").replace("cast(c_acctbal as varchar)", "c_acctbal")


@query("select concat('urn:customer:', c_custkey) as s from customer where c_nationkey <> 1")
def diff_snapshots(spark, sf_dir):
    a = graph(spark, sf_dir, "customer").scan(["urn:customer#c_nationkey"])
    return difference(a, a.where(F.col("o") == "urn:nation:1")).select("s")


@query("""select concat('urn:customer:', c_custkey) as s, case when c_mktsegment = 'BUILDING' then 'urn:customer#segment' else 'urn:customer#c_mktsegment' end as p, c_mktsegment as o from customer
union all select concat('urn:customer:', c_custkey), 'urn:customer#checked', 'true' from customer where c_mktsegment = 'BUILDING'""")
def insert_delete_where(spark, sf_dir):
    g = graph(spark, sf_dir, "customer").scan(["urn:customer#c_mktsegment"])
    chain = {
        "a.sparql": 'DELETE { ?c customer:c_mktsegment ?s } INSERT { ?c customer:segment ?s } WHERE { ?c customer:c_mktsegment ?s FILTER(?s = "#{[segment]}") }',
        "b.sparql": "INSERT { ?c customer:checked true } WHERE { ?c customer:segment ?s }",
    }
    return rules.run_updates(g, chain, {"segment": "BUILDING"}, P).select("s", "p", "o")


@query("select concat('urn:moved') as g, count(*) as n from customer")
def move_and_clear_graphs(spark, sf_dir):
    g = TableSource(spark, sf_dir, ("customer", "region"), graph=lambda t: F.lit(f"urn:graph:{t}")).scan([RDF_TYPE])
    g = compiler.update(g, "MOVE GRAPH <urn:graph:customer> TO GRAPH <urn:moved> ; CLEAR GRAPH <urn:graph:region>")
    return g.groupBy("g").agg(F.count("*").alias("n"))


# B: access


@query("select concat('urn:customer:', c_custkey) as s from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def find_by_attributes(spark, sf_dir):
    src = graph(spark, sf_dir, "customer")
    return access.find_matching(src, profile(), "Customer", {"segment": Node("lit", "BUILDING", STRING), "nation": Node("iri", "urn:nation:3")})


@query("select concat('urn:x:', k) as s from (select s_suppkey as k from supplier intersect select c_custkey from customer)")
def find_all_multi_type(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "supplier")
    both = src.scan([RDF_TYPE]).withColumn("s", F.concat(F.lit("urn:x:"), terms.local_name(F.replace("s", F.lit(":"), F.lit("/")))))
    p = load('{types: {Base: {rules: {rdfType: "urn:customer"}}, Both: {rules: {rdfType: "urn:supplier", subClassOf: "Base"}}}}')
    return access.find_all(both, p, "Both")


@query("""select concat('urn:customer:', c_custkey) as s, 'name' as attribute, c_name as value from customer union all select concat('urn:customer:', c_custkey), 'nation', concat('urn:nation:', c_nationkey) from customer join nation on n_nationkey = c_nationkey
union all select concat('urn:customer:', o_custkey), 'orders', concat('urn:orders:', o_orderkey) from orders join customer on o_custkey = c_custkey""")
def typed_values(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "nation", "orders")
    return access.values(src, profile(), "Customer", ["name", "nation", "orders"]).select("s", "attribute", F.col("value.value").alias("value"))


@query("""select s, event from (select concat('urn:user:', user_id) as s, concat('urn:events:', event_id) as event, row_number() over (partition by user_id order by strftime(ts, '%Y-%m-%dT%H:%M:%S') desc, concat('urn:events:', event_id)) as n from events) where n = 1""")
def latest_event_per_user(spark, sf_dir):
    src = graph(spark, sf_dir, "events")
    rows = run(src, "SELECT ?e ?u ?t WHERE { ?e events:user_id ?u ; events:ts ?t }")
    values = rows.select(F.concat(F.lit("urn:user:"), "u").alias("s"), F.lit("event").alias("attribute"), terms.iri(F.col("e")).alias("value"))
    return access.latest_date(values, rows.select(F.col("e").alias("s"), F.col("t").alias("date")), "event").select("s", F.col("value.value").alias("event"))


@query("""select distinct s, p from (select concat('urn:customer:', c_custkey) as s, 'urn:customer#c_nationkey' as p from customer where c_mktsegment = 'MACHINERY'
union all select concat('urn:nation:', c_nationkey), unnest(['urn:nation#n_name', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) from customer where c_mktsegment = 'MACHINERY' union all select concat('urn:customer:', c_custkey), 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' from customer where c_mktsegment = 'MACHINERY')""")
def path_loader(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "nation")
    roots = access.find_matching(src, profile(), "Customer", {"segment": Node("lit", "MACHINERY", STRING)})
    return access.load_paths(src, profile(), "Customer", roots, paths=["nation.name"]).select("s", "p").distinct()


@query("select concat('urn:customer:', k) as id, c_custkey is not null as exists from (select distinct o_custkey as k from orders union select -o_custkey from orders) left join customer on c_custkey = k")
def bulk_existence(spark, sf_dir):
    from graphloom.sources.store import QuadStore

    src = graph(spark, sf_dir, "customer")
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.explode(F.array("o_custkey", -F.col("o_custkey"))).alias("k")).distinct()
    store = QuadStore(spark)
    store.scan = src.scan
    return store.check_existing(keys.select(F.concat(F.lit("urn:customer:"), F.col("k").cast("string")).alias("id")))


# B: validation, shapes


@query("""select concat('urn:customer:', c_custkey) as s, 'orders' as attribute, 'maxCardinality' as rule, 12 as "limit", count(*) as n from customer join orders on o_custkey = c_custkey group by c_custkey having count(*) > 12""")
def validate_cardinality(spark, sf_dir):
    return validate.check_cardinalities(graph(spark, sf_dir, "customer", "orders"), profile(), "Customer")


@query("select concat('urn:orders:', o_orderkey) as s, 'status' as attribute, 'or' as rule, o_orderstatus as value, o_orderstatus in ('F', 'O') as conforms from orders union all select concat('urn:orders:', o_orderkey), 'customer', 'classId', concat('urn:customer:', o_custkey), exists (select 1 from customer where c_custkey = o_custkey) from orders")
def validate_range(spark, sf_dir):
    return validate.check_values(graph(spark, sf_dir, "orders", "customer"), profile(), "Order").withColumn("value", F.col("value.value"))


LANG_PROFILE = '{types: {Source: {rules: {rdfType: "urn:source"}, attributes: {text: {uri: "urn:text", rules: {minLangCardinality: 2, maxLangCardinality: 40}}}}}}'


@query("""with x as (select concat('urn:source:', source) as s, lang, count(*) as k from (select distinct source, lang, md5(text) as t from documents where text is not null and lang <> '') group by 1, 2), y as (select s, min(k) as lo, max(k) as hi from x group by s)
select s, 'text' as attribute, 'minLangCardinality' as rule, 2 as "limit", lo as n from y where lo < 2 union all select s, 'text', 'maxLangCardinality', 40, hi from y where hi > 40""")
def validate_lang(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = F.concat(F.lit("urn:source:"), "source")
    lit, none = F.lit, F.lit(None).cast("string")
    texts = docs.where("text is not null").select(none.alias("g"), s.alias("s"), lit("iri").alias("s_kind"), lit("urn:text").alias("p"), F.md5("text").alias("o"), lit("lit").alias("o_kind"), lit(terms.LANG_STRING).alias("o_dt"), F.coalesce("lang", lit("")).alias("o_lang"))
    types = docs.select(none.alias("g"), s.alias("s"), lit("iri").alias("s_kind"), lit(RDF_TYPE).alias("p"), lit("urn:source").alias("o"), lit("iri").alias("o_kind"), lit("").alias("o_dt"), lit("").alias("o_lang")).distinct()
    return validate.check_cardinalities(texts.unionByName(types), load(LANG_PROFILE), "Source")


@query("""with n as (select count(*) as n from customer)
select 'urn:customer' as type, 'urn:customer#' || c as property, n.n as instances, k as with_property, cast(k = n.n as int) as min_count, 1 as max_count, kind as node_kind, dts as datatypes, cls as class from n,
(select 'c_custkey' as c, count(c_custkey) as k, 'Literal' as kind, 'http://www.w3.org/2001/XMLSchema#long' as dts, null as cls from customer union all select 'c_name', count(c_name), 'Literal', 'http://www.w3.org/2001/XMLSchema#string', null from customer
union all select 'c_acctbal', count(c_acctbal), 'Literal', 'http://www.w3.org/2001/XMLSchema#double', null from customer union all select 'c_mktsegment', count(c_mktsegment), 'Literal', 'http://www.w3.org/2001/XMLSchema#string', null from customer
union all select 'c_nationkey', count(c_nationkey), 'IRI', '', 'urn:nation' from customer) x""")
def shacl_profile(spark, sf_dir):
    rows = shapes.infer(graph(spark, sf_dir, "customer", "nation")).where("type = 'urn:customer'")
    return rows.select("type", "property", "instances", "with_property", "min_count", "max_count", "node_kind", F.array_join("datatypes", ",").alias("datatypes"), "class")


@query("select 'urn:documents' as type, string_agg(distinct lang, ',' order by lang) as languages, true as unique_lang from documents where text is not null")
def shacl_languages(spark, sf_dir):
    rows = shapes.infer(UnionSource(graph(spark, sf_dir, "documents"))).where("property = 'urn:documents#text'")
    return rows.select("type", F.array_join("languages", ",").alias("languages"), "unique_lang")


# B: documents


@query("""with c as (select * from customer where c_mktsegment = 'BUILDING')
select concat('urn:customer:', c_custkey) as doc, concat('urn:customer:', c_custkey) as uri, 0 as level, 'name' as attribute, 'http://www.w3.org/2001/XMLSchema#string' as datatype, c_name as value from c
union all select concat('urn:customer:', c_custkey), concat('urn:customer:', c_custkey), 0, 'segment', 'http://www.w3.org/2001/XMLSchema#string', c_mktsegment from c
union all select concat('urn:customer:', c_custkey), concat('urn:customer:', c_custkey), 0, 'nation', 'reference', concat('urn:nation:', c_nationkey) from c
union all select concat('urn:customer:', c_custkey), concat('urn:customer:', c_custkey), 0, 'orders', 'http://www.w3.org/2000/01/rdf-schema#Resource', concat('urn:orders:', o_orderkey) from c join orders on o_custkey = c_custkey
union all select concat('urn:customer:', c_custkey), concat('urn:nation:', c_nationkey), 1, 'name', 'http://www.w3.org/2001/XMLSchema#string', n_name from c join nation on n_nationkey = c_nationkey""")
def json_doc_rows(spark, sf_dir):
    src = UnionSource(graph(spark, sf_dir, "customer", "nation"), _Without(graph(spark, sf_dir, "orders"), RDF_TYPE))
    roots = access.find_matching(src, profile(), "Customer", {"segment": Node("lit", "BUILDING", STRING)})
    rows = documents.to_rows(src, doc_profile(profile()), roots)
    return rows.where("attribute is not null").select("doc", "uri", "level", "attribute", "datatype", "value")


class _Without:
    """A source without one predicate."""

    def __init__(self, source, predicate: str):
        self.source, self.predicate = source, predicate

    def scan(self, predicates=None):
        return self.source.scan(predicates).where(F.col("p") != self.predicate)


@query("""select concat('urn:customer:', c_custkey) as id, '{"data":{"uri":"urn:customer:' || c_custkey || '","type":"Customer","attributes":{"name":{"xsd:string":"' || c_name || '"}}},"included":[]}' as json from customer""")
def json_documents(spark, sf_dir):
    src = graph(spark, sf_dir, "customer")
    part = search_index.Partition("customers", ("SELECT ?n WHERE { ?n a <urn:customer> }",), ("CONSTRUCT { ?n a <urn:customer> ; customer:c_name ?x } WHERE { ?n customer:c_name ?x }",))
    return search_index.build(src, [part], doc_profile(profile()), P | dict(terms.PREFIXES)).select("id", "json")


@query("""select concat('urn:customer:', c_custkey) as s, 'urn:customer#' || k as p, v as o from (select c_custkey, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) as k, unnest([c_name, c_mktsegment, concat('urn:nation:', c_nationkey)]) as v from customer)
union all select concat('urn:customer:', c_custkey), 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:customer' from customer
union all select distinct concat('urn:nation:', n_nationkey), k, v from (select n_nationkey, unnest(['urn:nation#n_name', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) as k, unnest([n_name, 'urn:nation']) as v from nation semi join customer on n_nationkey = c_nationkey)""")
def json_round_trip(spark, sf_dir):
    """Customers to documents, with their nations nested in them, and back."""
    src = graph(spark, sf_dir, "customer", "nation")
    d = doc_profile(profile())
    rows = documents.to_rows(src, d, access.find_all(src, profile(), "Customer"))
    return documents.from_json(documents.to_json(rows), d).select("s", "p", "o").distinct()


@query("select concat('urn:customer:', c_custkey) as s, concat('urn:customer#', c) as p from customer, (select unnest(['c_custkey', 'c_acctbal']) as c)")
def conversion_report(spark, sf_dir):
    return documents.uncovered(graph(spark, sf_dir, "customer"), doc_profile(profile())).select("s", "p")


@query("""select concat('urn:customer:', c_custkey) as root, 'orders.' || o_orderpriority as path, cast(o_orderkey as varchar) as value, true as is_list from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'
union all select concat('urn:customer:', c_custkey), 'customer.segment', c_mktsegment, false from customer where c_mktsegment = 'BUILDING'
union all select concat('urn:customer:', c_custkey), 'orders.status', string_agg(o_orderstatus, ' - ' order by o_orderstatus), false from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by c_custkey""")
def facets_segment_orders(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "orders")
    roots = access.find_matching(src, profile(), "Customer", {"segment": Node("lit", "BUILDING", STRING)})
    queries = (
        'SELECT ?root ?a ?key ?idIntegerList WHERE { ?o orders:o_custkey ?root ; orders:o_orderpriority ?key ; orders:o_orderkey ?idIntegerList BIND("orders" AS ?a) }',
        'SELECT ?root ?a ?key ?v WHERE { ?root customer:c_mktsegment ?v BIND("customer" AS ?a) BIND("segment" AS ?key) }',
        'SELECT ?root ?a ?key ?v WHERE { ?o orders:o_custkey ?root ; orders:o_orderstatus ?v BIND("orders" AS ?a) BIND("status" AS ?key) }',
    )
    return documents.facets(src, queries, P, "concat", roots).select("root", "path", "value", "is_list")


@query("""with e as (select event_id, props::json as p from events), pairs as (select a.event_id, a.p as x, b.p as y from e a join e b on b.event_id = a.event_id + 1),
k as (select event_id, k, json_extract(x, '$.' || k) as u, json_extract(y, '$.' || k) as v from pairs, (select unnest(list_distinct(list_concat(json_keys(x), json_keys(y)))) as k))
select event_id, '.' || k as path, case when v is null then 'field_only_in_from' when u is null then 'field_only_in_to' when json_type(u) = 'VARCHAR' then 'different_string_values' when json_type(u) in ('UBIGINT', 'BIGINT') then 'different_integer_values' when json_type(u) = 'BOOLEAN' then 'different_boolean_values' else 'different_decimal_values' end as kind
from k where u is distinct from v""")
def json_diff_props(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    pairs = e.join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("props").alias("b")), "event_id").withColumnRenamed("props", "a")
    return documents.json_diff(pairs).select("event_id", F.explode("differences").alias("d")).select("event_id", "d.path", "d.kind")


# B: canonical forms


ROUND_TRIP = """select 'urn:customer' as t, count(*) as n from customer union all select 'urn:nation', count(*) from nation"""


def _same_graph(graph_: DataFrame, back: DataFrame) -> DataFrame:
    """Instances of each type of a graph that was read back; none at all where a quad got lost or came."""
    lost = union(difference(graph_, back.hint("merge")), difference(back, graph_.hint("merge")))  # whole graphs, whatever their files' size
    typed = back.where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("t")).agg(F.count("*").alias("n"))
    return typed.join(lost.groupBy().agg(F.count("*").alias("lost")), F.col("lost") == 0, "left_semi")


@query(ROUND_TRIP)
def ntriples_round_trip(spark, sf_dir):
    g = set_of(graph(spark, sf_dir, "customer", "nation").scan(None))
    return _same_graph(g, rdf.from_lines(rules.cut(rdf.to_lines(g))))


def _documents_round_trip(spark: SparkSession, sf_dir: str, syntax: str) -> DataFrame:
    g = set_of(graph(spark, sf_dir, "customer", "nation").scan(None))
    path = f"{shared_dir(spark)}/graphloom/{syntax}-{uuid.uuid4().hex}"
    rdf.write(g, path, syntax=syntax, documents=max(2, g.count() // 100_000), prefixes=P)
    return _same_graph(g, rdf.read(spark, path, syntax))


@query(ROUND_TRIP)
def rdfxml_round_trip(spark, sf_dir):
    return _documents_round_trip(spark, sf_dir, "rdfxml")


@query(ROUND_TRIP)
def jsonld_round_trip(spark, sf_dir):
    return _documents_round_trip(spark, sf_dir, "jsonld")


@query(ROUND_TRIP)
def turtle_round_trip(spark, sf_dir):
    return _documents_round_trip(spark, sf_dir, "turtle")


HASH_TEXT = "'<urn:customer:' || c_custkey || '> <urn:customer#c_name> \"' || c_name || '\"'"


@query("select " + " || ".join(f"lpad(format('{{:x}}', bit_xor(('0x' || substr(sha256({HASH_TEXT}), {1 + 8 * i}, 8))::BIGINT)), 8, '0')" for i in range(8)) + " as hash from customer")
def graph_hash_xor(spark, sf_dir):
    return canon.model_hash(graph(spark, sf_dir, "customer").scan(["urn:customer#c_name"]))


@query(f"select sha256(string_agg(sha256({HASH_TEXT}), '' order by sha256({HASH_TEXT}))) as digest from customer")
def graph_digest(spark, sf_dir):
    return canon.model_digest(graph(spark, sf_dir, "customer").scan(["urn:customer#c_name"]))


def _blank_orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Customers that have orders, which are blank nodes with some of their columns."""
    o, lit = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.lit
    label, none = F.concat(lit("o"), F.col("o_orderkey").cast("string")), lit(None).cast("string")
    quad = lambda s, sk, p, x, xk, dt: o.select(none.alias("g"), s.alias("s"), lit(sk).alias("s_kind"), lit(p).alias("p"), x.alias("o"), lit(xk).alias("o_kind"), lit(dt).alias("o_dt"), lit("").alias("o_lang"))
    has = quad(F.concat(lit("urn:customer:"), F.col("o_custkey").cast("string")), "iri", "urn:has", label, "bnode", "")
    return union(has, *[quad(label, "bnode", f"urn:orders#{c}", F.col(c), "lit", STRING) for c in columns])


@query("""with b as (select o_custkey, sha256(string_agg(t, '' order by t)) as d from (select o_orderkey, o_custkey, unnest([sha256(' <urn:orders#o_orderstatus> "' || o_orderstatus || '"'), sha256(' <urn:orders#o_orderpriority> "' || o_orderpriority || '"')]) as t from orders) group by o_orderkey, o_custkey),
r as (select sha256(d || '<urn:customer:' || o_custkey || '> <urn:has> ') as t from b) select sha256(string_agg(t, '' order by t)) as digest from r""")
def blank_graph_digest(spark, sf_dir):
    return canon.model_digest(_blank_orders(spark, sf_dir, "o_orderstatus", "o_orderpriority"))


@query("""with b as (select distinct o_custkey, o_orderstatus as v, sha256(sha256(' <urn:orders#o_orderstatus> "' || o_orderstatus || '"')) as d from orders), w as (select max(length('<urn:orders#o_orderstatus>')) + 1 as k),
t as (select 0 as r, 'urn:customer:' || o_custkey as s, '<urn:customer:' || o_custkey || '>' || chr(10) || '<urn:has> ' || string_agg(' _:' || d, ',' || chr(10) || '          ' order by d) || ';' || chr(10) || '.' as x from b group by o_custkey
union all select distinct 1, d, '_:' || d || chr(10) || '<urn:orders#o_orderstatus>  "' || v || '";' || chr(10) || '.' from b) select sha256(string_agg(x, chr(10) || chr(10) order by r, s)) as hash from t""")
def blank_graph_hash(spark, sf_dir):
    return canon.model_hash(_blank_orders(spark, sf_dir, "o_orderstatus"))


@query("""with b as (select distinct o_custkey, o_orderpriority as v, sha256(sha256(' <urn:orders#o_orderpriority> "' || o_orderpriority || '"')) as d from orders),
t as (select 0 as r, concat('urn:customer:', o_custkey) as s, 'urn:has' as p, d as o from b union all select distinct 1, d, 'urn:orders#o_orderpriority', v from b)
select s, p, o, row_number() over (order by r, s, p, o) as n from t""")
def canonical_sort(spark, sf_dir):
    return canon.canonical_ranks(_blank_orders(spark, sf_dir, "o_orderpriority")).select("s", "p", "o", F.col("n").cast("long").alias("n"))


@query("select concat('urn:skolem/.well-known/genid/n', c_custkey) as s, c_name as o from customer")
def skolem_iris(spark, sf_dir):
    g = graph(spark, sf_dir, "customer").scan(["urn:customer#c_name"])
    blank = g.withColumn("s_kind", F.lit("bnode")).withColumn("s", F.concat(F.lit("n"), F.regexp_extract("s", r"(\d+)$", 1)))
    return canon.skolemize(blank).select("s", "o")


# B: rules and minting


@query("""with recursive e as (select distinct p_type as a, regexp_replace(p_type, ' ?[^ ]+$', '') as b from part where p_type like '% %' union select distinct regexp_replace(p_type, ' ?[^ ]+$', ''), regexp_replace(regexp_replace(p_type, ' ?[^ ]+$', ''), ' ?[^ ]+$', '') from part where p_type like '% % %'
union all select 'urn:cycle:' || i, 'urn:cycle:' || ((i + 1) % 4) from range(4) t(i)), c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a) select a, b from c""")
def subclass_closure(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("a")).distinct()
    up = lambda c: F.regexp_replace(c, " ?[^ ]+$", "")
    one = t.where(F.col("a").like("% %")).select("a", up("a").alias("b"))
    two = t.where(F.col("a").like("% % %")).select(up("a").alias("a"), up(up("a")).alias("b"))
    ring = spark.range(4).select(F.concat(F.lit("urn:cycle:"), F.col("id").cast("string")).alias("a"), F.concat(F.lit("urn:cycle:"), ((F.col("id") + 1) % 4).cast("string")).alias("b"))
    return rules.closure(one.union(two).union(ring))


@query("select concat('urn:minted/', year(o_orderdate), '/', o_orderkey) as s, concat('urn:minted/c/', o_custkey) as c from orders where o_totalprice > 350000")
def uri_minting(spark, sf_dir):
    src = graph(spark, sf_dir, "orders")
    g = compiler.construct(src, "CONSTRUCT { ?o a <urn:T> ; <urn:key> ?k ; <urn:year> ?y ; <urn:of> ?c . ?c a <urn:C> ; <urn:key> ?c } WHERE { ?o orders:o_totalprice ?t ; orders:o_orderkey ?k ; orders:o_orderdate ?d ; orders:o_custkey ?c BIND(YEAR(?d) AS ?y) FILTER(?t > 350000) }", P)
    temp = lambda c: F.when(F.col(c).startswith("urn:orders:") | F.col(c).startswith("urn:customer:"), F.concat(F.lit("urn:temp:"), F.substr(F.col(c), F.lit(5)))).otherwise(F.col(c))
    key = F.when((F.col("p") == "urn:key") & (F.col("o_kind") == "iri"), F.regexp_extract("o", r"(\d+)$", 1))
    g = g.withColumn("s", temp("s")).withColumn("o", F.coalesce(key, temp("o"))).withColumn("o_kind", F.when(key.isNotNull(), "lit").otherwise(F.col("o_kind"))).withColumn("o_dt", F.when(key.isNotNull(), STRING).otherwise(F.col("o_dt")))
    generators = [
        rules.Generator("SELECT ?x WHERE { ?x a <urn:T> }", "SELECT ?uri ?y ?k WHERE { ?uri <urn:year> ?y ; <urn:key> ?k }", "urn:minted/#{[y]}/#{[k]}"),
        rules.Generator("SELECT ?x WHERE { ?x a <urn:C> }", "SELECT ?uri ?k WHERE { ?uri <urn:key> ?k }", "urn:minted/c/#{[k]}"),
    ]
    return run(rules.mint(g, generators, "urn:temp:"), "SELECT ?s ?c WHERE { ?s <urn:of> ?c }")


@query("""with part_of as (select concat('urn:part:', p_partkey) as s, concat('urn:brand:', p_brand) as b from part),
classes as (select s from part_of union select b from part_of union select 'urn:goods' from part),
above as (select s, b as o from part_of union select s, 'urn:goods' from part_of union select b, 'urn:goods' from part_of union select s, 'http://www.w3.org/2002/07/owl#Thing' from classes),
props as (select concat('urn:nation:', n_nationkey) as s from nation union select concat('urn:region:', r_regionkey) from region)
select s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, 'http://www.w3.org/2002/07/owl#Class' as o from classes
union all select s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf', o from above
union all select s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/2002/07/owl#DatatypeProperty' from props
union all select s, 'http://www.w3.org/2000/01/rdf-schema#domain', 'urn:goods' from props
union all select s, 'http://www.w3.org/2000/01/rdf-schema#range', 'http://www.w3.org/2000/01/rdf-schema#Literal' from props""")
def ontology_expansion(spark, sf_dir):
    """All rules and the cleanup: parts as classes under brands, nations as properties under regions."""
    src, names = graph(spark, sf_dir, "part", "nation", "region"), {**P, **rules.ONTOLOGY_PREFIXES}
    classes = "CONSTRUCT { ?x a rdfs:Class ; rdfs:subClassOf ?b . ?b rdfs:subClassOf <urn:goods> } WHERE { ?x part:p_brand ?n BIND(IRI(CONCAT('urn:brand:', ?n)) AS ?b) }"
    tops = "CONSTRUCT { ?r a owl:DatatypeProperty ; rdfs:domain <urn:goods> ; rdfs:label ?n } WHERE { ?r region:r_name ?n }"
    below = "CONSTRUCT { ?x rdfs:subPropertyOf ?r } WHERE { ?x nation:n_regionkey ?r }"
    out = rules.expand_ontology(set_of(union(*[compiler.construct(src, q, names) for q in (classes, tops, below)])))
    return out.where(F.col("s").rlike("^urn:(part|brand|goods|nation|region)")).select("s", "p", "o")


# B: operations, permissions

OPERATIONS = """{ id: "customer", operations: {
    rich: {template: "ASK { ?contextUri customer:c_acctbal ?b FILTER(?b > 5000) }"},
    builder: {template: "ASK { ?contextUri customer:c_mktsegment 'BUILDING' }"},
    both: {requires: ["rich", "builder"]}, either: {optional: ["rich", "builder"]},
    closeable: {requires: ["order*/closed"]}, },
  groups: { order: {selectorQuery: "SELECT ?o WHERE { ?o orders:o_custkey ?contextUri }", multiselect: true,
    operations: { closed: {template: "ASK { ?contextUri orders:o_orderstatus 'F' }"}, upward: {requires: ["../rich"]} }, }, }, }"""


@query("""with o as (select o_custkey, o_orderkey, o_orderstatus = 'F' as closed from orders), a as (select c_custkey, c_acctbal > 5000 as rich, c_mktsegment = 'BUILDING' as builder, coalesce((select bool_and(closed) from o where o_custkey = c_custkey), true) as closeable from customer)
select concat('urn:customer:', c_custkey) as uri, '' as "group", concat('urn:customer:', c_custkey) as member, unnest(['rich', 'builder', 'both', 'either', 'closeable']) as operation, unnest([rich, builder, rich and builder, rich or builder, closeable]) as enabled from a
union all select concat('urn:customer:', c_custkey), 'order', concat('urn:orders:', o_orderkey), unnest(['closed', 'upward']), unnest([closed, rich]) from a join o on o_custkey = c_custkey""")
def operations_matrix(spark, sf_dir):
    src = graph(spark, sf_dir, "customer", "orders")
    uris = src.table("customer").select(src.subject("customer").alias("s"))
    return operations.evaluate(src, operations.load(OPERATIONS, prefixes=P), uris, prefixes=P)


@query("""select s as "user", p as permission from (select concat('u', c_custkey) as s, case when c_mktsegment in ('BUILDING', 'MACHINERY') then ['read', 'write'] else ['read'] end as ps from customer), lateral (select unnest(ps) as p)""")
def role_permissions(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    users = c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Editor").otherwise("reader").alias("role"))
    roles = spark.createDataFrame([("editor", ["read", "write"]), ("Reader", ["read"])], "role string, permissions array<string>")
    return operations.role_permissions(roles, users)


# B: sync, index


@query("""with s as (select o_orderkey as k, cast(o_totalprice as varchar) as v from orders), t as (select l_orderkey as k, case when max(l_returnflag) = 'R' then 'old' else cast(o_totalprice as varchar) end as v from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, o_totalprice union all select -c_custkey, c_name from customer)
select concat('urn:g:', coalesce(s.k, t.k)) as graph, case when s.k is null then 'delete' when t.k is null then 'update' when s.v = t.v then 'none' else 'update' end as action from s full join t on s.k = t.k""")
def sync_actions(spark, sf_dir):
    """Orders as the source; a target that has stale stamps of those with returned items, lacks those without items, and holds customers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    iri = lambda k: F.concat(F.lit("urn:g:"), k.cast("string")).alias("graph")
    source = read("orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("stamp"))
    stale = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_returnflag") == "R").alias("stale"))
    target = source.join(stale, "o_orderkey").select(iri(F.col("o_orderkey")), F.when(F.col("stale"), "old").otherwise(F.col("stamp")).alias("stamp"))
    others = read("customer").select(iri(-F.col("c_custkey")), F.col("c_name").alias("stamp"))
    return sync.sync_actions(source.select(iri(F.col("o_orderkey")), "stamp"), target.unionByName(others)).select("graph", "action")


@query("""select concat('urn:user:', user_id) as id, max(epoch_us(ts) // 1000) as t from events group by user_id having max(epoch_us(ts) // 1000) >= (select min(epoch_us(ts) // 1000) + 1000 from events)""")
def reindex_gc(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = e.select(F.concat(F.lit("urn:user:"), F.col("user_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("graph"), F.lit("User").alias("type"), ms.alias("timestampms"), F.lit("{}").alias("json"))
    first = e.agg(F.min(ms)).first()[0]  # one value
    table = search_index.upsert(rows.limit(0), rows)
    return search_index.collect_garbage(table, first + 1000).select("id", F.col("timestampms").alias("t"))


@query("""select g, concat('urn:part:', p_partkey) as s from part, lateral (select unnest(case when p_size < 10 and p_size % 2 = 0 then ['urn:small', 'urn:even'] when p_size < 10 then ['urn:small'] when p_size % 2 = 0 then ['urn:even'] else ['urn:rest'] end) as g)""")
def route_statements(spark, sf_dir):
    g = graph(spark, sf_dir, "part").scan(["urn:part#p_size"]).withColumn("s", F.concat(F.lit("urn:"), "o", F.lit("/"), F.regexp_extract("s", r"(\d+)$", 1)))
    out = sync.route(g, [(r"~urn:[0-9]/.*", "urn:small"), (r"~urn:[0-9]*[02468]/.*", "urn:even")], "urn:rest")
    return out.select("g", F.concat(F.lit("urn:part:"), F.substring_index("s", "/", -1)).alias("s"))


@query("""select concat('urn:draft:', p_partkey) as s, case when k = 0 then 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' else 'urn:label' end as p, case when k = 0 then 'urn:Draft' else p_name || ' (' || p_brand || ')' end as o from part, (select unnest([0, 1]) as k) where p_size > 3""")
def compose_graph(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("exists", F.col("p_size") > 3)
    t = sync.Template("urn:drafts", "urn:draft:${p_partkey}", (("urn:label", "${p_name} (${p_brand})", "add", XSD + "string"),), "urn:Draft", "exists")
    return sync.compose(graph(spark, sf_dir, "part").scan([]), rows, [t]).select("s", "p", "o")


@query("""select concat('urn:nation:', n_nationkey) as iri, 'nation' as kind, cast(n_nationkey as varchar) as key, 'urn%3Anation%3A' || n_nationkey as encoded, 'nation:' || n_name as curie, 'urn:nation#' || n_name as expanded from nation where n_name not like '% %'""")
def iri_functions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where(~F.col("n_name").like("% %"))
    iri = F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string"))
    groups = terms.regex_groups(iri, r"urn:(?<kind>[a-z]+):(?<key>\d+)")
    expanded = F.concat(F.lit("urn:nation#"), "n_name")
    curie = terms.shorten_iri(expanded, P)
    return n.select(iri.alias("iri"), groups["kind"].alias("kind"), groups["key"].alias("key"), terms.percent_encode(iri, "uri").alias("encoded"), curie.alias("curie"), terms.expand_curie(curie, P).alias("expanded"))


@query("""select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as h, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def windowed_events(spark, sf_dir):
    from graphloom.streaming import windowed_counts

    rows = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("h"), "n", F.round("total", 4).alias("total"))


# What the profile above says, attribute by attribute: type, attribute, IRI, range, its class or datatype, least, most, rules.
STATED = """(values ('Customer', 'name', 'urn:customer#c_name', 'http://www.w3.org/2001/XMLSchema#string', 'http://www.w3.org/2001/XMLSchema#string', 1, 1),
    ('Customer', 'segment', 'urn:customer#c_mktsegment', 'http://www.w3.org/2001/XMLSchema#string', 'http://www.w3.org/2001/XMLSchema#string', null, 1),
    ('Customer', 'nation', 'urn:customer#c_nationkey', 'Nation', 'urn:nation', null, 1), ('Customer', 'orders', 'urn:orders#o_custkey', 'Order', 'urn:orders', null, 12),
    ('Nation', 'name', 'urn:nation#n_name', 'http://www.w3.org/2001/XMLSchema#string', 'http://www.w3.org/2001/XMLSchema#string', 1, 1),
    ('Order', 'status', 'urn:orders#o_orderstatus', 'or', null, null, 1), ('Order', 'customer', 'urn:orders#o_custkey', 'Customer', 'urn:customer', 1, 1)) as a(t, id, uri, range_, target, lo, hi)"""
TYPES = "(values ('Customer', 'urn:customer'), ('Nation', 'urn:nation'), ('Order', 'urn:orders')) as k(t, iri)"


@query(f"""select t as type, id as attribute, uri, range_ as "range", coalesce(lo, 0) || '..' || coalesce(cast(hi as varchar), 'n') as cardinality, false as is_class, null::varchar as super_types, null::varchar as rdf_types,
    'maxCardinality, ' || case when lo is null then '' else 'minCardinality, ' end || 'range' as rules from {STATED}
union all select t, null, null, null, null, true, '', iri, null from {TYPES}""")
def collapsed_profile_sheet(spark, sf_dir):
    from graphloom.operators.ontology import to_sheet

    return to_sheet(spark, collapse(profile()))


@query(f"""with a as (select a.*, k.iri from {STATED} join {TYPES} on a.t = k.t), w as (select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as isa, 'http://www.w3.org/2000/01/rdf-schema#' as rdfs, 'http://www.w3.org/2002/07/owl#' as owl)
select iri as s, isa as p, owl || 'Class' as o from {TYPES}, w union select 'urn:profile:sales', isa, owl || 'Ontology' from w
union select uri, isa, owl || case when range_ like 'http%' then 'Datatype' else 'Object' end || 'Property' from a, w union select uri, rdfs || 'domain', iri from a, w
union select uri, rdfs || 'range', target from a, w where target is not null
union select iri, uri, 'minCardinality ' || lo from a where lo is not null union select iri, uri, 'maxCardinality ' || hi from a where hi is not null""")
def profile_to_owl(spark, sf_dir):
    """Statements without blank nodes, and each restriction as (class, property, count)."""
    from graphloom.operators.ontology import to_owl

    g = to_owl(spark, profile())
    named = g.where("s_kind = 'iri' and o_kind <> 'bnode'").select("s", "p", "o")
    of = lambda p, name: g.where(F.col("p").endswith(p) & (F.col("s_kind") == "bnode")).select(F.col("s").alias("b"), F.col("o").alias(name))
    classes = g.where(F.col("p").endswith("#subClassOf") & (F.col("o_kind") == "bnode")).select(F.col("o").alias("b"), "s")
    counts = g.where(F.col("p").endswith("Cardinality")).select(F.col("s").alias("b"), F.concat(F.substring_index("p", "#", -1), F.lit(" "), "o").alias("o"))
    return named.unionByName(classes.join(of("#onProperty", "p"), "b").join(counts, "b").select("s", "p", "o")).distinct()

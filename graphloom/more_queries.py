"""More queries over whole tables, with SQL: dates, editing, deltas, stores, pages, sorted text, rules of ontologies, indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import dates, terms
from graphloom.functions.terms import RDF_TYPE, STRING
from graphloom.operators import access, canon, documents, editing, owl_rules, rules, sync
from graphloom.operators import index as search_index
from graphloom.operators.profile import doc_profile
from graphloom.plans import compiler
from graphloom.queries import P, graph, profile, query
from graphloom.sources.quads import difference, set_of, union
from graphloom.sources.shared import shared_dir
from graphloom.sources.store import ParquetStore


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as xml, strftime(ts, '%Y%m%d') as short, strftime(ts, '%d-%m-%Y %H:%M') as dmy,
    epoch_ms(date_trunc('minute', ts)) as dmy_back, epoch_ms(date_trunc('second', ts)) as xml_back, strftime(ts + interval 31 day, '%Y-%m-%d') as rolled from events""")
def named_dates(spark, sf_dir):
    """Times written and read by named patterns; `rolled` reads a day 31 days too late, which a lenient reader rolls over."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    xml, short, dmy = (dates.format(F.col("ts"), n) for n in ("XMLDATETIME", "SHORTDATE", "DMY_HM"))
    late = F.concat(F.date_format("ts", "yyyy-MM-"), (F.dayofmonth("ts") + 31).cast("string"))
    return e.select(
        "event_id", xml.alias("xml"), short.alias("short"), dmy.alias("dmy"), F.unix_millis(dates.parse(dmy, "DMY_HM")).alias("dmy_back"),
        F.unix_millis(dates.parse_mandatory(xml, "XMLDATETIME")).alias("xml_back"), dates.format(dates.parse(late, "DATE"), "DATE").alias("rolled"),
    )


@query("""select o_orderkey, printf('%02d:%02d:%02d:%d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as took from (select o_orderkey, o_orderkey * 7919 as ms from orders)""")
def durations(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.duration(F.col("o_orderkey") * 7919).alias("took"))


@query("""with t as (select 'urn:customer:' || c_custkey as s, c_name as o from customer), r as (select s, (row_number() over (order by s) - 1) // 100 as page from t)
select page, count(*) as n, min(s) as first, max(s) as last from r group by page""")
def construct_pages(spark, sf_dir):
    """Pages of 100 quads of one ordered run."""
    rows = set_of(compiler.construct(graph(spark, sf_dir, "customer"), "CONSTRUCT { ?c <urn:n> ?n } WHERE { ?c customer:c_name ?n }", P))
    stored, _ = sync.pages(rows, 100)
    return stored.groupBy("page").agg(F.count("*").alias("n"), F.min("s").alias("first"), F.max("s").alias("last"))


@query("""select 'urn:customer:' || c_custkey as s, unnest(['name', 'segment', 'nation']) as attribute, unnest([c_name, c_mktsegment, 'urn:nation:' || c_nationkey]) as value from customer""")
def detached_customers(spark, sf_dir):
    found = editing.detach(graph(spark, sf_dir, "customer", "nation"), profile(), "Customer", keep=lambda n: n != "orders")
    return found.select("s", F.explode("attributes").alias("attribute", "values")).select("s", "attribute", F.explode("values").alias("v")).select("s", "attribute", F.col("v.value").alias("value"))


@query("""with c as (select 'urn:customer:' || c_custkey as s, c_mktsegment as old, upper(substr(c_mktsegment, 1, 4)) || case when c_acctbal < 0 then 'X' else substr(c_mktsegment, 5) end as new from customer)
select 'add' as action, s, 'urn:customer#c_mktsegment' as p, new as o from c where new <> old union all select 'remove', s, 'urn:customer#c_mktsegment', old from c where new <> old""")
def edited_customers(spark, sf_dir):
    """New segments for customers in debt: pairs of old and new, and the delta between them."""
    src, p = graph(spark, sf_dir, "customer"), profile()
    old = editing.detach(src, p, "Customer", keep=lambda n: n == "segment")
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("urn:customer:"), F.col("c_custkey").cast("string")).alias("s"), (F.col("c_acctbal") < 0).alias("debt"), "c_mktsegment")
    new = editing.empty(c, "Customer").join(c, "s").withColumn("v", F.array(F.concat(F.upper(F.substring("c_mktsegment", 1, 4)), F.when(F.col("debt"), "X").otherwise(F.substr("c_mktsegment", F.lit(5))))))
    new = editing.set_values(new, p, "Customer", "segment", "v").select("s", "type", "attributes")
    return editing.changes(editing.pair(new, old), p, "Customer").select("action", "s", "p", "o")


@query("""select 'urn:orders:' || o_orderkey as s, 'modified' as stamp, '2030-01-01T00:00:00Z' as o from orders where o_orderstatus = 'F' union all
select 'urn:orders:' || o_orderkey, 'created', case when o_orderpriority like '1%' then '2020-01-01T00:00:00Z' else '2030-01-01T00:00:00Z' end from orders where o_orderstatus = 'F' or o_orderpriority like '1%'""")
def stamped_orders(spark, sf_dir):
    """Finished orders get stamps; urgent ones were created before."""
    src = graph(spark, sf_dir, "orders")
    made = compiler.construct(src, 'CONSTRUCT { ?o <http://purl.org/dc/terms/created> "2020-01-01T00:00:00Z" } WHERE { ?o orders:o_orderpriority ?p FILTER(STRSTARTS(?p, "1")) }', P)
    done = src.scan(["urn:orders#o_orderstatus"]).where(F.col("o") == "F").select("s")
    out = sync.stamp_resources(made, done, "2030-01-01T00:00:00Z")
    return out.select("s", F.regexp_extract("p", "([^/]+)$", 1).alias("stamp"), "o")


@query("""select 'urn:part:' || p_partkey as s, case when p_size < 10 then 'urn:small' else 'urn:large' end as p, cast(p_size as varchar) as o from part where p_size <> 10""")
def rule_chain(spark, sf_dir):
    """Ordered updates, each on the state before it, one with a parameter; what they changed."""
    g = graph(spark, sf_dir, "part").scan(["urn:part#p_size"])
    chain = {
        "1-split": "INSERT { ?x <urn:small> ?n } WHERE { ?x part:p_size ?n FILTER(?n < #{[limit]}) }",
        "2-rest": "INSERT { ?x <urn:large> ?n } WHERE { ?x part:p_size ?n FILTER NOT EXISTS { ?x <urn:small> ?n } }",
        "3-drop": "DELETE { ?x <urn:large> ?n } WHERE { ?x <urn:large> ?n FILTER(?n = #{[limit]}) }",
    }
    added, _ = rules.rule_changes(g, chain, parameters={"limit": 10}, prefixes=P)
    return added.select("s", "p", "o")


@query("""select '<urn:customer:' || c_custkey || '>' as subject, '<urn:customer:' || c_custkey || '>' || chr(10) || '<urn:customer#c_mktsegment>  "' || c_mktsegment || '";' || chr(10) || rpad('<urn:customer#c_name>', cast(length('<urn:customer#c_mktsegment>') + 1 as integer), ' ') || ' "' || c_name || '";' || chr(10) || '.' as text from customer""")
def sorted_text(spark, sf_dir):
    return canon.sorted_turtle(graph(spark, sf_dir, "customer").scan(["urn:customer#c_name", "urn:customer#c_mktsegment"]), sort=False).select("subject", "text")


@query("""select 'urn:kept' as g, count(*) as n from customer where c_nationkey <> 1 union all select 'urn:copy', count(*) from supplier""")
def store_versions(spark, sf_dir):
    """A Parquet store through adds, removals, a replaced and a moved graph, read again by another session object."""
    folder = f"{shared_dir(spark)}/graphloom/store-{uuid.uuid4().hex}"
    store = ParquetStore(spark, folder)
    c, s = graph(spark, sf_dir, "customer").scan(["urn:customer#c_nationkey"]), graph(spark, sf_dir, "supplier").scan(["urn:supplier#s_name"])
    store.add_data(c, "urn:customers")
    store.remove_data(c.where(F.col("o") == "urn:nation:1").withColumn("g", F.lit("urn:customers")))
    store.replace_graph("urn:suppliers", s.limit(1))
    store.replace_graph("urn:suppliers", s)
    store.move_graph("urn:customers", "urn:kept")
    store.move_graph("urn:suppliers", "urn:copy")
    return ParquetStore(spark, folder).quads.groupBy("g").agg(F.count("*").alias("n"))


@query("""select 'urn:customer:' || c_custkey as s, case when c_mktsegment = 'BUILDING' then upper(c_name) else c_name end as o from customer""")
def routed_view(spark, sf_dir):
    """Names from a main graph, those of builders from a graph of their own by a routing table."""
    g = graph(spark, sf_dir, "customer").scan(["urn:customer#c_name"])
    both = g.withColumn("g", F.lit("urn:main")).unionByName(g.withColumns({"g": F.lit("urn:loud"), "o": F.upper("o")}))
    routes = access.find_matching(graph(spark, sf_dir, "customer"), profile(), "Customer", {"segment": compiler.Node("lit", "BUILDING", STRING)})
    return editing.GraphView(both, "urn:main", routes.select("s", F.lit("urn:loud").alias("g"))).scan(["urn:customer#c_name"]).select("s", "o")


@query("""select 'urn:customer:' || k as id, c_custkey is not null as found from (select distinct o_custkey as k from orders union select -o_custkey from orders) left join customer on c_custkey = k""")
def index_fetch(spark, sf_dir):
    """Documents of an index by id, for ids of which half aren't there."""
    src = graph(spark, sf_dir, "customer")
    part = search_index.Partition("customers", ("SELECT ?n WHERE { ?n a <urn:customer> }",), ("CONSTRUCT { ?n a <urn:customer> ; customer:c_name ?x } WHERE { ?n customer:c_name ?x }",))
    rows = search_index.build(src, [part], doc_profile(profile()), P | dict(terms.PREFIXES))
    keys = read(spark, sf_dir, "orders").select(F.explode(F.array("o_custkey", -F.col("o_custkey"))).alias("k")).distinct()
    return search_index.fetch(rows, keys.select(F.concat(F.lit("urn:customer:"), F.col("k").cast("string")).alias("id"))).select("id", "found")


@query("""select 'urn:customer:' || c_custkey as s, unnest(['c_custkey', 'c_acctbal']) as p from customer""")
def cleaned_round_trip(spark, sf_dir):
    """What a graph loses when it is cleaned for documents."""
    src = graph(spark, sf_dir, "customer")
    kept = documents.clean(src, doc_profile(profile()))
    return difference(set_of(src.scan(None)), kept).select("s", F.regexp_extract("p", "#(.*)$", 1).alias("p"))


@query("""select 'subClassOf' as kind, 'urn:part:' || p_partkey as subject, null::varchar as "on", 'urn:brand:' || p_brand as value, 0 as number from part
union all select 'minCardinality', 'urn:part:' || p_partkey, 'urn:size', null, p_size from part union all select 'class', 'urn:part:' || p_partkey, null, null, 0 from part
union all select 'extra', 'urn:part:' || p_partkey, 'urn:named', p_name, 0 from part""")
def ontology_rules(spark, sf_dir):
    """Parts as classes, each with its brand above it, a least number of sizes and a name, read as rules."""
    src, names = graph(spark, sf_dir, "part"), {**P, **rules.ONTOLOGY_PREFIXES}
    classes = "CONSTRUCT { ?x a owl:Class ; rdfs:subClassOf ?b ; <urn:named> ?t } WHERE { ?x part:p_brand ?n ; part:p_name ?t BIND(IRI(CONCAT('urn:brand:', ?n)) AS ?b) }"
    sizes = src.scan(["urn:part#p_size"])
    node, lit = F.concat(F.lit("r"), F.regexp_extract("s", r"(\d+)$", 1)), F.lit
    row = lambda s, sk, p, o, ok, dt="": sizes.select(lit(None).cast("string").alias("g"), s.alias("s"), lit(sk).alias("s_kind"), lit(p).alias("p"), o.alias("o"), lit(ok).alias("o_kind"), lit(dt).alias("o_dt"), lit("").alias("o_lang"))
    owl, xsd = terms.OWL, terms.XSD
    limits = [
        row(F.col("s"), "iri", terms.RDFS + "subClassOf", node, "bnode"), row(node, "bnode", RDF_TYPE, lit(owl + "Restriction"), "iri"), row(node, "bnode", owl + "onProperty", lit("urn:size"), "iri"),
        row(node, "bnode", owl + "minCardinality", F.col("o"), "lit", xsd + "nonNegativeInteger"),
    ]
    found = owl_rules.rules_of(set_of(union(compiler.construct(src, classes, names), *limits)), expand=False)
    return found.where(F.col("subject").startswith("urn:part:")).withColumn("number", F.coalesce("number", F.lit(0)))


@query("""select 'urn:customer:' || c_custkey as s from customer where c_acctbal > 9000 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) or not exists (select 1 from orders where o_custkey = c_custkey)""")
def rich_or_idle(spark, sf_dir):
    """EXISTS inside a disjunction."""
    text = "SELECT ?s WHERE { ?s customer:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o orders:o_custkey ?s ; orders:o_totalprice ?t FILTER(?t > 400000) } || NOT EXISTS { ?o orders:o_custkey ?s }) }"
    return compiler.values(compiler.select(graph(spark, sf_dir, "customer", "orders"), text, P))

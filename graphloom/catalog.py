"""The registered graph queries, by name, on graphs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import derived, oracles
from graphloom.functions import sets
from graphloom.functions.sketches import estimate, sketch
from graphloom.graph import Graph
from graphloom.operators import centrality, communities, components, convolve, kcore, mutual, neighbourhood, pagerank, propagation, spread, traversal, walks
from graphloom.operators.encode import encode
from graphloom.plans.messages import aggregate_messages, spread_messages
from graphloom.plans.scratch import Scratch
from graphloom.sources import loaders, readers, writers

Query = Callable[[SparkSession, str], DataFrame]

RANK_ROUNDS = 8
LABEL_ROUNDS = 3
CONVOLVE_ROUNDS = 2
N_STEPS = 2
DEPTH = 40


def _on(name: str, body: Callable[[Graph], DataFrame], directed: bool = False) -> Query:
    return lambda spark, sf_dir: body(derived.graph(spark, sf_dir, name, directed))


def _low_roots(g: Graph) -> DataFrame:
    return g.vertices().orderBy("vid").limit(5).select(F.col("vid").alias("root"))


def _major_roots(g: Graph) -> DataFrame:
    named = components.labels(g)
    major = components.major_label(named.groupBy("label").agg(F.count("*").alias("vertices")))
    return named.join(F.broadcast(major), "label", "left_semi").orderBy("vid").limit(5).select(F.col("vid").alias("root"))


def _rounded(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def _subsets(g: Graph) -> DataFrame:
    a, b = g.edges.where("src % 3 <> 0").select(F.col("src").alias("vid")), g.vertices().where("vid % 2 = 0")
    ops = (("union", sets.union), ("intersection", sets.intersection), ("difference", sets.difference))
    out = [sets.size_and_last(f(a, b)).select(F.lit(n).alias("op"), "members", "last") for n, f in ops]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _state(g: Graph) -> DataFrame:
    old = g.vertices().where("vid % 2 = 0").withColumn("value", F.col("vid") * 2)
    return sets.upsert(old, g.edges.select(F.col("dst").alias("vid"), F.col("src").alias("value")), "min")


def _messages(g: Graph) -> DataFrame:
    state = g.vertices().withColumn("value", F.col("vid"))
    return aggregate_messages(g.arcs(), state, [F.min("value").alias("least"), F.count("*").alias("n")])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = lines.groupBy(F.col("l_partkey").alias("vid")).agg(F.collect_set("l_suppkey").alias("items"))
    return mutual.mutual_items(derived.graph(spark, sf_dir, "g_pp"), items).select("src", "dst", "n")


def _convolve(g: Graph) -> DataFrame:
    features = g.vertices().select("vid", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("vid") % (i + 7)).cast("double") * 0.3).alias("features"))
    return convolve.convolve(g, features, CONVOLVE_ROUNDS).select("vid", F.posexplode("features").alias("pos", "f")).select("vid", "pos", F.round("f", 6).alias("f"))


def _types(g: Graph) -> DataFrame:
    return g.vertices().select("vid", (F.col("vid") % 2).cast("int").alias("type"))


def _spread(friends: bool) -> Query:
    return lambda spark, sf_dir: spread.spread(derived.edges(spark, sf_dir, "g_pp"), derived.behaviours(spark, sf_dir), ["quantity"], friends=friends)


def _sketched(g: Graph) -> DataFrame:
    return g.arcs().groupBy(F.col("src").alias("vid")).agg(estimate(sketch("dst", 12)).alias("about"), F.count_distinct("dst").alias("exact"))


def _anf(g: Graph) -> DataFrame:
    value = neighbourhood.average_distance(g, bits=10)
    return g.edges.sparkSession.range(1).select(F.lit(value).alias("average_distance"))


def _cells(g: Graph, k: int = 16) -> DataFrame:
    """A fixed partition."""
    return g.vertices().withColumn("community", F.col("vid") % k)


def _code_length(g: Graph) -> DataFrame:
    return g.edges.sparkSession.range(1).select(F.round(F.lit(communities.code_length(g, _cells(g))), 6).alias("code_length"))


def _walk_facts(walked: DataFrame, arcs: DataFrame, kinds: int = 0) -> DataFrame:
    """A row for each place in the path: walks that are so long, steps from the place before that are no arc, places of a wrong type."""
    at = walked.select("walk", F.posexplode("path").alias("step", "vid")).withColumn("step", F.col("step").cast("long"))
    steps = walked.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(i.cast("long").alias("step"), F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst")))).alias("s"))
    wrong = steps.select("s.*").where("dst is not null").join(arcs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").groupBy("step").agg(F.count("*").alias("no_arc"))
    odd = F.sum(F.when(F.col("vid") % kinds != F.col("step") % kinds, 1).otherwise(0)) if kinds else F.lit(0)
    known = at.groupBy("step").agg(F.count("*").alias("walks"), odd.cast("long").alias("odd_type"))
    return known.join(wrong, "step", "left").select("step", "walks", F.coalesce("no_arc", F.lit(0).cast("long")).alias("no_arc"), "odd_type")


def _sketch_band(g: Graph) -> DataFrame:
    return _sketched(g).select("vid", "exact", (F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.1 * F.col("exact"))).alias("close"))


def _steps_band(g: Graph) -> DataFrame:
    about = neighbourhood.n_step_degrees(g, N_STEPS, bits=12).select("vid", F.col("in_degree").alias("about"))
    exact = neighbourhood.exact_n_step_degrees(g, N_STEPS)
    return exact.join(about, "vid").select("vid", "in_degree", (F.abs(F.col("about") - F.col("in_degree")) <= F.greatest(F.lit(2.0), 0.12 * F.col("in_degree"))).alias("close"))


def _through_files(write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], table: Callable[[SparkSession, str], DataFrame]) -> Query:
    """What a reader makes of a file that a writer has left."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = Scratch(spark, "files").root + "/table"
        write(table(spark, sf_dir), path)
        return read(spark, path)

    return query


def _weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("int").alias("weight"))


def _vertex_text(column: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("vid"), F.expr(column).alias("value"))


def _loaded_and_decoded(spark: SparkSession, path: str) -> DataFrame:
    """Edges read with encoding, and their ids decoded again."""
    g, codes = loaders.load_encoded(spark, path, payload="uint32")
    return loaders.decoded(g.edges, codes, ["src", "dst"])


def queries() -> dict[str, Query]:
    return {
        "o11_spread": _spread(False),
        "o11_spread_friends": _spread(True),
        "g1_graph_info": _on("g_cs", Graph.info_table),
        "g2_g5_degrees_directed": _on("g_cs", Graph.degrees, directed=True),
        "g2_g5_degrees_undirected": _on("g_pp", Graph.degrees),
        "g6_weighted_degrees": _on("g_ev", Graph.weighted_degrees, directed=True),
        "g7_degree_distribution": _on("g_cs", Graph.degree_distribution),
        "g7_density": _on("g_cs", lambda g: _rounded(g.density(), "density", 9)),
        "g9_symmetrise": _on("g_ps", lambda g: g.arcs().select("src", "dst")),
        "g10_reverse": _on("g_ps", lambda g: g.reversed().edges.select("src", "dst")),
        "g11_vertex_subsets": _on("g_pp", _subsets),
        "g12_map_reduce": _on("g_pp", lambda g: sets.total(g.vertices(), F.col("vid") % 10, g.edges.select(F.col("src").alias("vid")))),
        "g14_state_upsert": _on("g_pp", _state),
        "m1_aggregate_messages": _on("g_pp", _messages),
        "m16_distinct_sketch": _on("g_pp", _sketched),
        "a1_bfs": _on("g_tree", traversal.bfs, directed=True),
        "a2_pagerank": _on("g_ps", lambda g: _rounded(pagerank.pagerank(g, RANK_ROUNDS, eps=0), "rank")),
        "a3_weighted_pagerank": _on("g_ev", lambda g: _rounded(pagerank.pagerank(g, RANK_ROUNDS, eps=0, weighted=True), "rank"), directed=True),
        "a4_components": _on("g_ps", components.labels),
        "a4_component_sizes": _on("g_ps", lambda g: components.sizes(g, components.labels(g))),
        "a4_component_edges": _on("g_ps", lambda g: components.labelled_edges(g, components.labels(g))),
        "a4_major_component": _on("g_ps", lambda g: components.sub_graph(g, components.labels(g))),
        "a5_encode": _on("g_cs", lambda g: encode(g)[0].edges.select("src", "dst")),
        "a6_label_propagation": _on("g_pp", lambda g: propagation.label_propagation(g, LABEL_ROUNDS)),
        "a7_hop_attenuation": _on("g_pp", lambda g: _rounded(propagation.hop_attenuation(g, LABEL_ROUNDS, tolerance=1e-5), "score")),
        "a8_coreness": _on("g_pp", kcore.coreness),
        "a8_shells": _on("g_pp", lambda g: kcore.shells(g, kcore.coreness(g)).groupBy("coreness").agg(F.count("*").alias("arcs"))),
        "a8_core_subgraph": _on("g_pp", lambda g: kcore.core_subgraph(g, kcore.coreness(g), 8).select("src", "dst")),
        "a9_closeness": _on("g_ps", lambda g: _rounded(centrality.closeness(g, _low_roots(g)), "closeness", 9)),
        "a10_hop_distance": _on("g_ps", lambda g: traversal.hops(g, _low_roots(g)).select("root", "vid", "dist")),
        "a11_sampled_closeness": _on("g_ps", lambda g: _rounded(centrality.sampled_closeness(g, roots=_major_roots(g)), "closeness", 9)),
        "a12_betweenness": _on("g_ps", lambda g: _rounded(centrality.sampled_betweenness(g, roots=_major_roots(g)), "betweenness")),
        "a13_average_distance": _on("g_ps", lambda g: _rounded(neighbourhood.exact_average_distance(g), "average_distance", 9)),
        "a13_average_distance_sketch": _on("g_ps", _anf),
        "a14_n_step_degrees": _on("g_ps", lambda g: neighbourhood.exact_n_step_degrees(g, N_STEPS)),
        "a14_n_step_degrees_sketch": _on("g_ps", lambda g: neighbourhood.n_step_degrees(g, N_STEPS, bits=10)),
        "a15_tree_statistics": _on("g_tree", traversal.tree_statistics, directed=True),
        "a16_louvain": _on("g_pp", communities.louvain),
        "a17_density_louvain": _on("g_pp", communities.density_louvain),
        "a18_infomap": _on("g_ps", communities.infomap),
        "o10_mutual": _on("g_pp", mutual.mutual_neighbours),
        "o10_mutual_lists": _on("g_pp", lambda g: mutual.mutual_neighbours(g, lists=True).withColumn("common", F.array_join("common", ":"))),
        "o10_mutual_items": _items,
        "w1_node2vec": _on("g_pp", lambda g: walks.node2vec(g, steps=6)),
        "w2_metapath": _on("g_cs", lambda g: walks.metapath(g, _types(g), [0, 1], epochs=1, steps=4)),
        "x1_convolve": _on("g_pp", _convolve),
        "g13_fill": _on("g_pp", lambda g: sets.fill(g.vertices(), 7)),
        "g14_update_if": _on("g_pp", lambda g: sets.update_if(g.vertices().where("vid % 2 = 0").withColumn("value", F.col("vid") * 2), g.edges.select(F.col("dst").alias("vid"), F.col("src").alias("value")), F.col("new") * 4 < F.col("old"))),
        "m2_spread_messages": _on("g_pp", lambda g: spread_messages(g.vertices(), F.when(F.col("vid") % 3 != 0, F.col("vid") % 10), [F.sum("vid").alias("total"), F.count("*").alias("n")])),
        "m16_sketch_band": _on("g_pp", _sketch_band),
        "a14_sketch_band": _on("g_ps", _steps_band),
        "a16_modularity": _on("g_pp", lambda g: _rounded(communities.modularity(g, _cells(g)), "modularity", 9)),
        "a18_code_length": _on("g_ps", _code_length),
        "w1_walk_facts": _on("g_pp", lambda g: _walk_facts(walks.node2vec(g, steps=6), g.arcs())),
        "w2_walk_facts": _on("g_cs", lambda g: _walk_facts(walks.metapath(g, _types(g), [0, 1], epochs=1, steps=4), g.arcs(), 2)),
        "i3_edges_through_csv": _through_files(writers.write_csv, lambda spark, path: readers.load_edges(spark, path, "uint32").withColumn("weight", F.col("weight").cast("long")), _weighted_edges),
        "i4_vertices_through_csv": _through_files(writers.write_csv, lambda spark, path: readers.load_vertices(spark, path, "double"), _vertex_text("p_retailprice")),
        "i7_libsvm": _through_files(writers.write_csv, lambda spark, path: readers.parse_libsvm(readers.load_vertices(spark, path)).select("vid", "label", F.size("features").cast("long").alias("features"), F.expr("cast(features[0].value as double)").alias("first")), _vertex_text("concat(p_size, ' 0:', p_size, '.5 3:1 x:9')")),
        "i8_libsvm_dense": _through_files(writers.write_csv, lambda spark, path: readers.parse_libsvm(readers.load_vertices(spark, path), 5).select("vid", F.expr("cast(features[3] as double)").alias("fourth"), F.expr("cast(features[4] as double)").alias("fifth")), _vertex_text("concat(p_size, ' 0:1 3:', p_size, '.25')")),
        "i11_encoded_load": _through_files(writers.write_csv, _loaded_and_decoded, _weighted_edges),
        "i12_lists_through_csv": _through_files(lambda df, path: writers.write_csv(df, path, columns=["vid", "items"]), readers.load_lists, lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("vid")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("items"))),
        "i13_behaviours_through_csv": _through_files(writers.write_csv, lambda spark, path: readers.load_behaviours(spark, path, 1), derived.behaviours),
    }


def oracle_sql() -> dict[str, str]:
    """SQL for all but whole walks, sketches and communities, of which SQL tells facts, and the exact mean distance, which is too slow there."""
    return {
        "o11_spread": oracles.spread(False),
        "o11_spread_friends": oracles.spread(True),
        "g1_graph_info": oracles.info("g_cs"),
        "g2_g5_degrees_directed": oracles.degrees("g_cs", True),
        "g2_g5_degrees_undirected": oracles.degrees("g_pp", False),
        "g6_weighted_degrees": oracles.strengths("g_ev"),
        "g7_degree_distribution": oracles.distribution("g_cs"),
        "g7_density": oracles.density("g_cs"),
        "g9_symmetrise": f"WITH {oracles._arcs('g_ps')} SELECT src, dst FROM arcs",
        "g10_reverse": f"WITH {oracles._arcs('g_ps')} SELECT dst AS src, src AS dst FROM edges",
        "g11_vertex_subsets": oracles.subsets("g_pp"),
        "g12_map_reduce": oracles.map_reduce("g_pp"),
        "g14_state_upsert": oracles.state("g_pp"),
        "m1_aggregate_messages": oracles.messages("g_pp"),
        "a1_bfs": oracles.bfs("g_tree", 0),
        "a2_pagerank": oracles.pagerank("g_ps", RANK_ROUNDS),
        "a3_weighted_pagerank": oracles.pagerank("g_ev", RANK_ROUNDS, weighted=True),
        "a4_components": oracles.components("g_ps"),
        "a4_component_sizes": oracles.component_sizes("g_ps"),
        "a4_component_edges": oracles.component_edges("g_ps", False),
        "a4_major_component": oracles.component_edges("g_ps", True),
        "a5_encode": oracles.encoded("g_cs"),
        "a6_label_propagation": oracles.label_propagation("g_pp", LABEL_ROUNDS),
        "a7_hop_attenuation": oracles.hop_attenuation("g_pp", LABEL_ROUNDS, 0.1, 1e-5),
        "a8_coreness": oracles.coreness("g_pp"),
        "a8_shells": oracles.shell_sizes("g_pp"),
        "a8_core_subgraph": oracles.core_edges("g_pp", 8),
        "a9_closeness": oracles.closeness("g_ps"),
        "a10_hop_distance": oracles.hop_pairs("g_ps", DEPTH),
        "a11_sampled_closeness": oracles.sampled_closeness("g_ps"),
        "a12_betweenness": oracles.sampled_betweenness("g_ps", DEPTH),
        "a14_n_step_degrees": oracles.n_step_degrees("g_ps", N_STEPS),
        "a15_tree_statistics": oracles.tree("g_tree", 0),
        "o10_mutual": oracles.mutual("g_pp", False),
        "o10_mutual_lists": oracles.mutual("g_pp", True),
        "o10_mutual_items": oracles.mutual_items("g_pp"),
        "x1_convolve": oracles.convolve("g_pp", CONVOLVE_ROUNDS),
        "g13_fill": oracles.filled("g_pp"),
        "g14_update_if": oracles.updated("g_pp"),
        "m2_spread_messages": oracles.spread_sums("g_pp"),
        "m16_sketch_band": oracles.distinct_neighbours("g_pp"),
        "a14_sketch_band": oracles.n_step_band("g_ps", N_STEPS),
        "a16_modularity": oracles.modularity("g_pp", 16),
        "a18_code_length": oracles.code_length("g_ps", 16),
        "w1_walk_facts": oracles.walk_facts("g_pp", 6),
        "w2_walk_facts": oracles.walk_facts("g_cs", 4, "WHERE vid % 2 = 0"),
        "i3_edges_through_csv": oracles.WEIGHTED_EDGES,
        "i4_vertices_through_csv": "SELECT p_partkey AS vid, p_retailprice AS value FROM part",
        "i7_libsvm": "SELECT p_partkey AS vid, p_size AS label, CAST(2 AS BIGINT) AS features, p_size + 0.5::DOUBLE AS first FROM part",
        "i8_libsvm_dense": "SELECT p_partkey AS vid, p_size + 0.25::DOUBLE AS fourth, 0.0::DOUBLE AS fifth FROM part",
        "i11_encoded_load": oracles.WEIGHTED_EDGES,
        "i12_lists_through_csv": "SELECT l_partkey AS vid, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS items FROM lineitem GROUP BY 1",
        "i13_behaviours_through_csv": "SELECT l_partkey AS vid, l_suppkey AS behaviour_id, CAST(sum(l_quantity) AS BIGINT) AS s1 FROM lineitem GROUP BY 1, 2",
    }

"""Queries of the code-intelligence operators over the supplied tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import views
from .functions.columns import ACCENTED, PLAIN, dirname, dot, pascal_case, terms
from .operators import graph, intervals, lines, resolve, search
from .plans.index import classify
from .views import read, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return add


_QUERY_VECTOR = [0.125 if i % 3 else -0.25 for i in range(64)]
_LITERAL = "[" + ",".join(map(str, _QUERY_VECTOR)) + "]::double[]"
_COS = f"list_dot_product(embedding::double[], {_LITERAL}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * {sum(x * x for x in _QUERY_VECTOR) ** 0.5!r})"
_TERMS = f"regexp_extract_all(translate(lower(content), '{ACCENTED}', '{PLAIN}'), '[a-z0-9]+')"


@query("select path, line_number::bigint as line_number, line from (select path, unnest(generate_series(1, len(ls))) as line_number, unnest(ls) as line from (select path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) as ls from files)) where regexp_matches(line, '[Ll]icen[sc]e')", "files")
def F7_grep(spark, sf_dir) -> DataFrame:
    return lines.grep(views.files(spark, sf_dir), "[Ll]icen[sc]e")


@query("select path, array_to_string(list_slice(string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1, 2), chr(10)) as text from files", "files")
def S12_span(spark, sf_dir) -> DataFrame:
    from .sources.repo import read_span

    return read_span(views.files(spark, sf_dir), 1, 2)


@query("select doc_id, sha256(text) as hash, substring(sha256(source || '/' || lang || '/' || doc_id || text), 1, 16) as chunk_id, len(regexp_replace(text, '\\s', '', 'g'))::bigint as size from documents")
def X1_hashes(spark, sf_dir) -> DataFrame:
    from .functions.columns import non_blank_length, short_hash

    f = views.files(spark, sf_dir)
    return f.select("doc_id", "hash", short_hash("path", "content").alias("chunk_id"), non_blank_length(F.col("content")).cast("long").alias("size"))


@query("select symbol_id, name, kind, path from symbols where name = 'cold widget'", "symbols")
def F1_definition(spark, sf_dir) -> DataFrame:
    return graph.find_definition(views.symbols(spark, sf_dir), "cold widget").select("symbol_id", "name", "kind", "path")


@query("(select symbol_id as id, name as label, kind, path from symbols where contains(name, 'widget') order by id limit 10) union all (select path, path, 'file', path from files where contains(path, 'widget') order by path limit 10)", "symbols", "files")
def F2_label_search(spark, sf_dir) -> DataFrame:
    return graph.find_by_label(views.symbols(spark, sf_dir), views.files(spark, sf_dir), "widget")


@query("select id, label, kind, path from nodes", "nodes")
def F6_node_view(spark, sf_dir) -> DataFrame:
    return views.nodes(spark, sf_dir)


@query("select id, label, kind, path from nodes where id = 'p1'", "nodes")
def F3_node_by_id(spark, sf_dir) -> DataFrame:
    return views.nodes(spark, sf_dir).where("id = 'p1'")


@query("select relation, count(*) as n from edges group by 1 union all select 'files', count(*) from files union all select 'symbols', count(*) from symbols union all select 'chunks', count(*) from chunks", "edges", "files", "symbols", "chunks")
def A2_stats(spark, sf_dir) -> DataFrame:
    out = views.edges(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"))
    for name in ("files", "symbols", "chunks"):
        out = out.union(getattr(views, name)(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(name), "n"))
    return out


@query("select a.m as source_module, b.m as target_module, count(*) as strength from edges join (select id, regexp_extract(path, '^(.*)/[^/]*$', 1) as m from nodes) a on src = a.id join (select id, regexp_extract(path, '^(.*)/[^/]*$', 1) as m from nodes) b on dst = b.id where relation = 'imports' and a.m <> b.m and a.m <> '' and b.m <> '' group by 1, 2", "edges", "nodes")
def A3_module_coupling(spark, sf_dir) -> DataFrame:
    return graph.coupling(views.edges(spark, sf_dir), views.nodes(spark, sf_dir))


@query("select id, label, kind, path, count(src) as in_degree from nodes left join (select * from edges where relation = 'calls') on dst = id group by all order by in_degree desc, id limit 10", "edges", "nodes")
def A4_central_nodes(spark, sf_dir) -> DataFrame:
    return graph.central(views.edges(spark, sf_dir), views.nodes(spark, sf_dir), 10).select("id", "label", "kind", "path", "in_degree")


@query("select dst, count(*) as in_degree from edges where relation = 'calls' group by 1", "edges")
def A5_in_degree(spark, sf_dir) -> DataFrame:
    return search.in_degrees(views.edges(spark, sf_dir))


@query("select distinct id, label, kind, path from edges join nodes on src = id where relation = 'imports' and dst = 's3'", "edges", "nodes")
def J2_referrers(spark, sf_dir) -> DataFrame:
    e = views.edges(spark, sf_dir).where("relation = 'imports'").withColumn("relation", F.lit("calls"))
    return graph.references(e, views.nodes(spark, sf_dir), "s3")


@query("select src, dst, relation from edges where dst = 'p7'", "edges")
def J4_neighbours(spark, sf_dir) -> DataFrame:
    return graph.neighbours(views.edges(spark, sf_dir), "p7", "in")


#: Rank of a symbol's path s.path for a reference's path r.path.
_NEAR = "case when r.path = s.path then 0 when regexp_extract(r.path, '^(.*)/[^/]*$', 1) = regexp_extract(s.path, '^(.*)/[^/]*$', 1) then 1 when regexp_extract(regexp_extract(r.path, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1) <> '' and starts_with(s.path, regexp_extract(regexp_extract(r.path, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1)) then 2 else 3 end"
_PARTS = "select p_partkey::varchar as ref_id, p_brand || '/' || (p_size % 50 + 1) || '/' || p_partkey as path, p_name as name, p_size::varchar as context from part), s as (select 'p' || p_partkey as symbol_id, p_brand || '/' || p_size || '/' || p_partkey as path, p_name as name from part)"


def _part_refs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each part's name is referred to from the folder of the next size."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    refs = p.select(key.alias("ref_id"), F.concat_ws("/", "p_brand", (F.col("p_size") % 50 + 1).cast("string"), key).alias("path"), F.lit("call").alias("ref_kind"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("alias"), F.col("p_size").cast("string").alias("context"), F.lit(1).alias("line"))
    symbols = p.select(F.concat(F.lit("p"), key).alias("symbol_id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), key).alias("path"), F.col("p_name").alias("name"))
    return refs, symbols


@query(f"with r as ({_PARTS}, k as (select ref_id, symbol_id, row_number() over (partition by ref_id order by {_NEAR}, symbol_id) as n from r join s using (name)) select ref_id, symbol_id from k where n = 1")
def J6_proximity(spark, sf_dir) -> DataFrame:
    refs, symbols = _part_refs(spark, sf_dir)
    return resolve.nearest(refs.select("ref_id", "path", "name"), symbols.withColumnRenamed("path", "to_path"), ["name"]).select("ref_id", "symbol_id")


@query(f"with r as ({_PARTS}, k as (select ref_id, symbol_id, row_number() over (partition by ref_id order by case when contains(s.path, context) then 0 else 1 end, {_NEAR}, symbol_id) as n from r join s using (name)) select ref_id, symbol_id from k where n = 1")
def J5_resolve(spark, sf_dir) -> DataFrame:
    """Calls whose context is a size: symbols with that in their path come first."""
    return resolve.resolve(*_part_refs(spark, sf_dir)).select("ref_id", "symbol_id")


@query("select p_brand as path, coalesce(case when p_size < 10 then p_type end, regexp_extract(replace(p_name, ' ', '.'), '([^:./]*)$', 1)) as local, arg_min(replace(p_name, ' ', '.'), struct_pack(line := p_size, name := replace(p_name, ' ', '.'))) as full_name from part group by 1, 2")
def J7_import_scope(spark, sf_dir) -> DataFrame:
    """Part names as imports of their brand; small sizes go by an alias."""
    p = read(spark, sf_dir, "part")
    refs = p.select(F.col("p_brand").alias("path"), F.lit("import").alias("ref_kind"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.when(F.col("p_size") < 10, F.col("p_type")).alias("alias"), F.col("p_size").alias("line"))
    return resolve.import_scope(refs).select("path", "local", F.col("full").alias("full_name"))


@query("select src, dst, a.path as src_path, b.path as dst_path from edges join nodes a on src = a.id join nodes b on dst = b.id where relation = 'imports'", "edges", "nodes")
def J3_import_paths(spark, sf_dir) -> DataFrame:
    return graph.import_paths(views.edges(spark, sf_dir), views.nodes(spark, sf_dir))


@query("select src, string_agg(label, ', ' order by label) as names from (select distinct src, label from edges join nodes on dst = id where relation = 'calls') group by 1", "edges", "nodes")
def J15_called_names(spark, sf_dir) -> DataFrame:
    return graph.called_names(views.edges(spark, sf_dir), views.nodes(spark, sf_dir)).select("src", F.array_join("names", ", ").alias("names"))


@query(", f as (select path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) as ls from files where language = 'en'), l as (select path, ls, unnest(generate_series(1, len(ls))) as n, unnest(ls) as line from f) select distinct path, n::bigint as line_number, array_to_string(list_slice(ls, greatest(n - 2, 1), n + 2), chr(10)) as code from l where contains(line, 'icense')", "files")
def J20_usages(spark, sf_dir) -> DataFrame:
    """Lines of English documents that hold a text, with two lines on either side; documents call their language."""
    f = views.files(spark, sf_dir)
    nodes = f.select(F.col("path").alias("id"), "path")
    calls = f.select(F.col("path").alias("src"), F.col("language").alias("dst"), F.lit("calls").alias("relation"))
    return lines.usages(calls, nodes, f, "en", "icense")


@query("select path, n::bigint as line_number, line from (select path, unnest(generate_series(1, len(ls))) as n, unnest(ls) as line from (select path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) as ls from files where contains(path, '/en/'))) where regexp_matches(line, '[Ll]icen[sc]e')", "files")
def F8_grep_filtered(spark, sf_dir) -> DataFrame:
    return lines.grep(views.files(spark, sf_dir), "[Ll]icen[sc]e", language="python", path_glob="*/en/*")


@query("(select symbol_id as id, name as label, kind, path from symbols where contains(name, 'widget') and contains(path, '#1') order by id limit 10) union all (select path, path, 'file', path from files where contains(path, 'widget') and contains(path, '#1') order by path limit 10)", "symbols", "files")
def F9_symbol_search(spark, sf_dir) -> DataFrame:
    return graph.find_by_label(views.symbols(spark, sf_dir), views.files(spark, sf_dir), "widget", "#1")


@query("select distinct src, dst, relation from edges where (src = 'n3' or dst = 'n3') and relation in ('defines')", "edges")
def F10_edge_kinds(spark, sf_dir) -> DataFrame:
    return graph.both_ways(views.edges(spark, sf_dir), "n3", 1)[1].where(F.col("relation").isin("defines"))


@query("select src, dst, relation from edges where src = 'n3'", "edges")
def G3_outgoing(spark, sf_dir) -> DataFrame:
    return graph.bfs(views.edges(spark, sf_dir), "n3", "out", 1)[1]


@query("select symbol_id, name, kind, path from symbols where name = 'cold widget' order by case when kind in ('class', 'struct', 'enum', 'interface') then 0 else 1 end, symbol_id limit 1", "symbols")
def G7_type_definition(spark, sf_dir) -> DataFrame:
    return graph.type_definition(views.symbols(spark, sf_dir), "cold widget").select("symbol_id", "name", "kind", "path")


@query("select symbol_id, path as file from symbols", "symbols")
def G12_file_of_id(spark, sf_dir) -> DataFrame:
    from .functions.columns import file_of_id, symbol_id

    return views.symbols(spark, sf_dir).select("symbol_id", file_of_id(symbol_id(F.col("path"), F.col("name"))).alias("file"))


@query("select distinct array_to_string(list_slice(p, 1, n), '/') as path, n < len(p) as is_dir from (select string_split(path, '/') as p, unnest(generate_series(1, least(2, len(string_split(path, '/'))))) as n from files where not regexp_matches(path, '(^|/)[.]')) order by path limit 100", "files")
def S11_listing(spark, sf_dir) -> DataFrame:
    from .sources.repo import listing

    return listing(views.files(spark, sf_dir), depth=2)


@query("select page_id, case page_id % 4 when 0 then 'python' when 1 then 'rust' when 2 then 'cpp' end as language from pages")
def S6_language(spark, sf_dir) -> DataFrame:
    from .sources.repo import language_of

    ends = F.array(*[F.lit(x) for x in ("py", "rs", "h", "unknown")])
    path = F.concat(F.col("url"), F.lit("."), F.element_at(ends, (F.col("page_id") % 4 + 1).cast("int")))
    return read(spark, sf_dir, "pages").select("page_id", language_of(path).alias("language"))


@query("select path, language, hash from files", "files")
def S9_files(spark, sf_dir) -> DataFrame:
    return views.files(spark, sf_dir).select("path", "language", "hash")


@query("select count(*) as n from files", "files")
def A1_count_files(spark, sf_dir) -> DataFrame:
    return views.files(spark, sf_dir).agg(F.count("*").alias("n"))


@query(", o as (select path, hash from files where language <> 'en'), n as (select path, case when language = 'de' then sha256(content || '!') else hash end as hash from files where language <> 'fr') select case when o.hash is null then 'new' when n.hash is null then 'removed' when o.hash = n.hash then 'skipped' else 'updated' end as status, count(*) as n from o full join n on o.path = n.path group by 1", "files")
def A9_index_stats(spark, sf_dir) -> DataFrame:
    """English documents are new, German ones changed, French ones gone."""
    f = views.files(spark, sf_dir)
    new = f.where("language <> 'fr'").withColumn("hash", F.when(F.col("language") == "de", F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("hash")))
    return classify(f.where("language <> 'en'"), new).groupBy("status").agg(F.count("*").alias("n"))


@query("select path, hash from files where language <> 'en' union all select path, sha256(content || '!') from files where language = 'en'", "files")
def K1_replace_rows(spark, sf_dir) -> DataFrame:
    """English documents are replaced by changed ones."""
    from .plans.index import replace_rows

    f = views.files(spark, sf_dir).select("path", "language", "content", "hash")
    en = f.where("language = 'en'")
    return replace_rows(f, en, en.withColumn("hash", F.sha2(F.concat("content", F.lit("!")), 256))).select("path", "hash")


@query("select distinct src, dst, relation from edges", "edges")
def U6_unique_edges(spark, sf_dir) -> DataFrame:
    e = views.edges(spark, sf_dir)
    return graph.unique_edges(e.union(e))


_RANGES = "select 't' || conv_id || '-' || turn as symbol_id, 'v' || conv_id as path, turn * 10 + 1 + conv_id % 9 as start_line, turn * 10 + 1 + conv_id % 9 + turn % 5 as end_line from conversations"


def _ranges(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    start = F.col("turn") * 10 + 1 + F.col("conv_id") % 9
    return c.select(F.concat_ws("-", F.concat(F.lit("t"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("symbol_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("path"), start.alias("start_line"), (start + F.col("turn") % 5).alias("end_line")).distinct()


@query(f", s as (select distinct * from ({_RANGES})), c as (select distinct chunk_id, path, start_line, end_line from chunks), m as (select symbol_id, chunk_id, c.start_line as c0, s.start_line >= c.start_line and s.end_line <= c.end_line as inside from s join c on s.path = c.path and s.start_line <= c.end_line and s.end_line >= c.start_line), k as (select *, row_number() over (partition by symbol_id order by inside desc, c0, chunk_id) as n, bool_or(inside) over (partition by symbol_id) as any_in from m) select symbol_id, chunk_id from k where not any_in or n = 1", "chunks")
def J8_symbol_chunks(spark, sf_dir) -> DataFrame:
    return intervals.symbol_chunks(_ranges(spark, sf_dir), views.chunks(spark, sf_dir).drop("content").distinct())


@query(f", s as (select distinct * from ({_RANGES})), r as (select distinct conv_id || ':' || turn as ref_id, 'v' || conv_id as path, turn * 10 + 3 as line from conversations), n as (select ref_id, symbol_id, row_number() over (partition by ref_id order by end_line - start_line, symbol_id) as k from r join s on r.path = s.path and line between start_line and end_line), c as (select ref_id, chunk_id, row_number() over (partition by ref_id order by start_line, chunk_id) as k from r join chunks on r.path = chunks.path and line between start_line and end_line) select r.ref_id, r.path, r.line, coalesce(symbol_id, chunk_id, r.path) as node from r left join (select * from n where k = 1) n on n.ref_id = r.ref_id left join (select * from c where k = 1) c on c.ref_id = r.ref_id", "chunks")
def J10_line_nodes(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    r = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("path"), (F.col("turn") * 10 + 3).alias("line")).distinct()
    return intervals.line_nodes(r, _ranges(spark, sf_dir), views.chunks(spark, sf_dir))


@query("select symbol_id, name, path from symbols where exists (select 1 from (select p_brand || '/' || p_size as path, p_size + 2 as s, p_size + 3 as e from part) d where d.path = symbols.path and symbols.start_line <= d.e and symbols.end_line >= d.s)", "symbols")
def J11_affected(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("path"), (F.col("p_size") + 2).alias("start"), (F.col("p_size") + 3).alias("end"))
    return intervals.affected(views.symbols(spark, sf_dir), d).select("symbol_id", "name", "path")


@query(", o as (select path, hash from files where doc_id % 10 <> 2), n as (select path, case when doc_id % 10 = 1 then sha256(content || '!') else hash end as hash from files where doc_id % 10 <> 0) select coalesce(o.path, n.path) as path, case when o.hash is null then 'new' when n.hash is null then 'removed' when o.hash = n.hash then 'skipped' else 'updated' end as status from o full join n on o.path = n.path", "files")
def J12_incremental(spark, sf_dir) -> DataFrame:
    """Documents against a changed copy: keys ending in 0 removed, in 1 changed, in 2 added."""
    f = views.files(spark, sf_dir)
    new = f.where("doc_id % 10 <> 0").withColumn("hash", F.when(F.col("doc_id") % 10 == 1, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("hash")))
    return classify(f.where("doc_id % 10 <> 2"), new)


@query(f", ix as (select chunk_id, unnest(list_distinct({_TERMS})) as term from chunks) select chunk_id from ix where term in ('the', 'of') group by 1 having count(*) = 2", "chunks")
def T3_text_match(spark, sf_dir) -> DataFrame:
    return search.match(search.postings(views.chunks(spark, sf_dir)), "The of")


@query(f", ix as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, len({_TERMS}) as dl, unnest({_TERMS}) as term from chunks) group by 1, 2), t as (select count(*) as n, avg(dl) as al from (select chunk_id, any_value(dl) as dl from ix group by 1)), f as (select term, count(*) as df from ix where term in ('the', 'thnd') group by 1) select chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) as score from ix join f using (term), t group by 1", "chunks")
def T4_bm25(spark, sf_dir) -> DataFrame:
    return search.bm25(search.postings(views.chunks(spark, sf_dir)), "the thnd").withColumn("score", F.round("score", 6))


@query(f"select vec_id, round({_COS}, 6) as score from embeddings order by {_COS} desc, vec_id limit 10")
def T5_knn(spark, sf_dir) -> DataFrame:
    return search.knn(read(spark, sf_dir, "embeddings"), _QUERY_VECTOR, 10, "vec_id").withColumn("score", F.round("score", 6))


@query(f"with h as (select vec_id, {_COS} as score from embeddings order by 2 desc, 1 limit 10), d as (select l_partkey, count(distinct l_orderkey) as in_degree from lineitem group by 1) select vec_id, coalesce(in_degree, 0) as in_degree, round(score * (1 + ln(1 + coalesce(in_degree, 0)) * 0.1), 6) as final_score from h left join d on l_partkey = vec_id order by score * (1 + ln(1 + coalesce(in_degree, 0)) * 0.1) desc, vec_id limit 5")
def T6_rerank(spark, sf_dir) -> DataFrame:
    """Vector candidates reranked by the calls of the part that holds them (vector i belongs to part i)."""
    hits = search.knn(read(spark, sf_dir, "embeddings"), _QUERY_VECTOR, 10, "vec_id")
    part = F.concat(F.lit("p"), F.col("vec_id").cast("string"))
    held = hits.select(part.alias("src"), F.col("vec_id").cast("string").alias("dst"), F.lit("contains").alias("relation"))
    calls = views.edges(spark, sf_dir).where("relation = 'calls'")
    out = search.rerank(hits.withColumn("vec_id", F.col("vec_id").cast("string")), calls.union(held), 5, "vec_id")
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "in_degree", F.round("final_score", 6).alias("final_score"))


_LISTS = f", ix as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, len({_TERMS}) as dl, unnest({_TERMS}) as term from chunks) group by 1, 2), t as (select count(*) as n, avg(dl) as al from (select chunk_id, any_value(dl) as dl from ix group by 1)), f as (select term, count(*) as df from ix where term in ('the', 'of') group by 1), s as (select term, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) as score from ix join f using (term), t)"


@query(", a as (select chunk_id from chunks where contains(content, 'blethe')), h as (select distinct src from edges join a on dst = chunk_id where relation = 'contains') select chunk_id, 1.0::double as score from a union all select distinct dst, 0.5::double from edges join h using (src) where relation = 'contains' and dst not in (select chunk_id from a)", "chunks", "edges")
def T11_context(spark, sf_dir) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    e = views.edges(spark, sf_dir)
    return search.with_context(c.where(F.col("content").contains("blethe")).select("chunk_id"), e)


@query(", walk as (select 'r1' as id, 0 as hop union select dst, hop + 1 from walk join edges on src = id where relation = 'defines' and hop < 2) select id, min(hop) as hop from walk group by 1", "edges")
def G4_bfs(spark, sf_dir) -> DataFrame:
    return graph.bfs(views.edges(spark, sf_dir), "r1", "out", 2, ["defines"])[0]


@query("select distinct src, dst, relation from edges where src = 'n3' or dst = 'n3'", "edges")
def U2_both_ways(spark, sf_dir) -> DataFrame:
    return graph.both_ways(views.edges(spark, sf_dir), "n3", 1)[1]


@query(", walk as (select 'r1' as id, 1.0::double as score, 0 as hop union all select dst, score * 0.5 * case relation when 'defines' then 1.25 when 'imports' then 0.75 end, hop + 1 from walk join edges on src = id where relation in ('defines', 'imports') and hop < 3) select id, round(max(score), 6) as score from walk group by 1", "edges")
def G11_weighted(spark, sf_dir) -> DataFrame:
    e = views.edges(spark, sf_dir)
    return graph.weighted(e, "r1", 3, 0.5, {"defines": 1.25, "imports": 0.75}).withColumn("score", F.round("score", 6))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || substring(w, 2)), '') as type_name from part")
def G8_type_name(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", pascal_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("type_name"))


@query("select path, name, n from (select path, name, row_number() over (partition by path order by start_line, symbol_id) as n from symbols) where n <= 5", "symbols")
def W3_first_five(spark, sf_dir) -> DataFrame:
    s = search.first_per(views.symbols(spark, sf_dir), "path", 5, "start_line", "symbol_id")
    from pyspark.sql import Window

    return s.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "symbol_id")).cast("long")).select("path", "name", "n")


@query("select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as module from files", "files")
def X8_dirname(spark, sf_dir) -> DataFrame:
    return views.files(spark, sf_dir).select("path", dirname(F.col("path")).alias("module"))


@query(f"select term, count(*) as df from (select unnest(list_distinct({_TERMS})) as term from files) group by 1", "files")
def T1_analyzer(spark, sf_dir) -> DataFrame:
    return views.files(spark, sf_dir).select(F.explode(F.array_distinct(terms(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("with v as (select vec_id, label, embedding::double[] as e from embeddings) select a.label, count(*) as n, round(avg(list_dot_product(a.e, b.e)), 6) as mean from v a join v b on a.vec_id + 1 = b.vec_id group by 1")
def X2_dot(spark, sf_dir) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(b, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(dot(F.col("embedding"), F.col("other"))), 6).alias("mean"))

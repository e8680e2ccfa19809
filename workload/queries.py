"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions.text import terms
from shortlist.functions.vectors import cosine, l2_normalize, norm
from shortlist.operators import context as ctx
from shortlist.operators import conversations as conv
from shortlist.operators import evaluation as ev
from shortlist.operators import filters as flt
from shortlist.operators import hybrid, lexical, lookup, postings, stored_cells
from shortlist.operators import responses as rsp
from shortlist.operators import vector_search as vec
from shortlist.operators.joins import spread_join
from shortlist.operators.queries import Limits, query_table
from shortlist.plans import turns as plan
from shortlist.plans.evaluation import evaluate
from shortlist.session import materialize, shared_folder
from shortlist.sources import catalog as cat
from shortlist.sources import conversations as src
from shortlist.streaming.turns import process_answered_stream, process_stream
from workload import views

# Sends nothing to every task: forces the plans for large query tables.
NOTHING_SENT = Limits(queries=0, bytes=0)


def r6(value: Column | str) -> Column:
    """Six digits, no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def joined(values: Column | str, mark: str = "|") -> Column:
    """A list as one text, so that results compare in any engine."""
    return F.array_join(values, mark)


def digest(vector: Column | str) -> Column:
    """Digest of all components in millionths; of nothing, if there is no vector."""
    parts = F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("long"))
    return F.md5(F.coalesce(joined(parts, ","), F.lit("")))


def flat_items(rows: DataFrame) -> DataFrame:
    """Catalog rows with lists as texts and the vector as its digest."""
    return rows.select(
        "id",
        "name",
        "url",
        joined("test_types").alias("test_types"),
        F.md5("description").alias("description_md5"),
        "duration",
        joined("job_levels").alias("job_levels"),
        "remote_testing",
        "adaptive",
        digest("embedding").alias("embedding_md5"),
    )


def recs_text(recs: Column | str = "recommendations") -> Column:
    """Recommendations as one text."""
    return joined(F.transform(recs, lambda r: F.concat_ws("~", r["name"], r["url"], r["test_type"])))


# --- sources, sinks, projections --------------------------------------------


def catalog_scan(spark, sf):
    return flat_items(views.catalog(spark, sf))


def catalog_ingest(spark, sf):
    """JSON lines to a stored catalog and back; every third item has its text encoded."""
    folder = os.path.join(shared_folder(spark), f"catalog-{uuid.uuid4().hex}")
    vector = F.when(F.col("id") % 3 != 0, F.col("embedding"))
    views.catalog(spark, sf).withColumn("embedding", vector).write.json(f"{folder}/lines")
    cat.write_catalog(cat.ingest_catalog(spark.read.text(f"{folder}/lines"), views.chat_encoder()), f"{folder}/items")
    return flat_items(cat.read_catalog(spark, f"{folder}/items"))


def conversation_fold(spark, sf):
    folded = src.fold_conversations(views.chats(spark, sf))
    text = joined(F.transform("messages", lambda m: F.concat_ws("~", m["role"], m["content"])))
    return folded.select("conv_id", F.size("messages").alias("n"), F.md5(text).alias("messages_md5"))


def response_emit(spark, sf):
    return rsp.to_responses(rsp.clean_responses(views.raw_responses(spark, sf)))


def catalog_coerce(spark, sf):
    return flat_items(cat.coerce_nulls(views.catalog(spark, sf)))


def recommendation_view(spark, sf):
    return cat.to_recommendation(views.catalog(spark, sf))


def detail_view(spark, sf):
    rows = cat.to_detail(views.catalog(spark, sf))
    return rows.withColumns(
        {
            "test_types": joined("test_types"),
            "job_levels": joined("job_levels"),
            "description": F.md5("description"),
        }
    )


def catalog_urls(spark, sf):
    return cat.catalog_urls(views.catalog(spark, sf))


# --- filters ----------------------------------------------------------------


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name")


def filter_test_type(spark, sf):
    return _ids(flt.filter_test_type(views.catalog(spark, sf), ["K", "P"]))


def filter_job_level(spark, sf):
    return _ids(flt.filter_job_level(views.catalog(spark, sf), "Executive"))


def filter_remote(spark, sf):
    return _ids(flt.filter_remote(views.catalog(spark, sf), True))


def filter_adaptive(spark, sf):
    return _ids(flt.filter_adaptive(views.catalog(spark, sf), False))


def filter_duration(spark, sf):
    return _ids(flt.filter_duration_max(views.catalog(spark, sf), 30))


COMBINED = {
    "test_type": ["K", "A", "S"],
    "job_level": ["Manager", "Director", "Executive"],
    "remote_testing": False,
    "adaptive": True,
    "duration_max": 40,
}


def filter_combined(spark, sf):
    return _ids(flt.apply_filters(views.catalog(spark, sf), COMBINED))


def filter_per_query(spark, sf):
    return flt.eligible_counts(views.search_queries(spark, sf, filtered=True), views.items(spark, sf))


# --- text and keyword search ------------------------------------------------


def lexical_tokens(spark, sf):
    rows = views.table(spark, sf, "documents").select("doc_id", terms(F.col("text")).alias("terms"))
    return rows.select("doc_id", F.size("terms").alias("n"), F.md5(joined("terms", " ")).alias("terms_md5"))


def lexical_index(spark, sf):
    return views.new_index(spark, sf).postings.select("id", "term", "tf", "length")


def lexical_term_stats(spark, sf):
    return views.new_index(spark, sf).term_stats


def lexical_score(spark, sf):
    table = query_table(views.search_queries(spark, sf))
    hits = lexical.lexical_hits(table, views.index(spark, sf))
    return hits.select("query_id", "id", r6("raw").alias("raw"))


def lexical_match_all(spark, sf):
    table = query_table(views.search_queries(spark, sf))
    hits = lexical.lexical_hits(table, views.index(spark, sf), require_all=True)
    return hits.select("query_id", "id", r6("raw").alias("raw"))


def search_lexical(spark, sf):
    found = lexical.search_lexical(views.search_queries(spark, sf, filtered=True), views.index(spark, sf))
    return found.withColumn("bm25_score", r6("bm25_score"))


def search_lexical_stored(spark, sf):
    queries = views.search_queries(spark, sf, filtered=True)
    found = postings.search_postings(queries, views.postings(spark, sf))
    return found.withColumn("bm25_score", r6("bm25_score"))


def search_lexical_any(spark, sf):
    queries = views.search_queries(spark, sf, filtered=True)
    found = postings.search_postings(queries, views.postings(spark, sf), require_all=False)
    return found.withColumn("bm25_score", r6("bm25_score"))


# --- vectors ----------------------------------------------------------------


def vector_normalize(spark, sf):
    rows = views.table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    unit = rows.select("vec_id", l2_normalize(scaled).alias("unit"))
    places = unit.select("vec_id", r6(norm(F.col("unit"))).alias("norm"), F.posexplode("unit").alias("place", "x"))
    return places.withColumn("x", r6("x"))


def text_encode(spark, sf):
    texts = views.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return vec.hashing_encoder()(texts).select("query_id", digest("vector").alias("vector_md5"))


def vector_cosine(spark, sf):
    rows = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = rows.join(other, "vec_id")
    return pairs.select("vec_id", r6(cosine(F.col("embedding"), F.col("next"))).alias("cosine"))


def _vector_result(found: DataFrame) -> DataFrame:
    return found.withColumn("cosine_score", r6("cosine_score"))


def search_vector(spark, sf):
    queries = views.search_queries(spark, sf)
    return _vector_result(vec.search_vector(queries, views.items(spark, sf)))


def search_vector_filtered(spark, sf):
    queries = views.search_queries(spark, sf, filtered=True)
    return _vector_result(vec.search_vector(queries, views.items(spark, sf)))


def search_vector_grid(spark, sf):
    queries = views.search_queries(spark, sf, filtered=True)
    return _vector_result(vec.search_vector(queries, views.items(spark, sf), limits=NOTHING_SENT))


def search_vector_cells(spark, sf):
    items = views.labelled_items(spark, sf)
    queries = views.search_queries(spark, sf, filtered=True)
    return _vector_result(vec.search_cells(queries, items, vec.cell_centroids(items), n_probe=3))


def search_vector_kmeans(spark, sf):
    cells, centroids = vec.build_cells(views.items(spark, sf), views.KMEANS_CELLS)
    queries = views.search_queries(spark, sf)
    return _vector_result(vec.search_cells(queries, cells, centroids, n_probe=views.KMEANS_PROBES))


def search_vector_stored_cells(spark, sf):
    queries = views.search_queries(spark, sf, filtered=True)
    return _vector_result(stored_cells.search_stored_cells(queries, views.cells(spark, sf), n_probe=3))


# --- fusion -----------------------------------------------------------------


def hybrid_minmax(spark, sf):
    index = views.index(spark, sf)
    table = query_table(views.search_queries(spark, sf, filtered=True))
    hits = hybrid.minmax(lexical.lexical_hits(table, index), table, index)
    return hits.select("query_id", "id", r6("value").alias("bm25_score"))


def _joined_scores(spark, sf):
    """Full scores of the items that are among the ten best by keywords or by vector."""
    index = views.index(spark, sf)
    queries = views.search_queries(spark, sf, filtered=True)
    table = query_table(queries)
    words, scales = hybrid.best_hits(table, index, 10)
    near = vec.search_vector(queries, index.items)
    keys = ["query_id", "id"]
    pairs = materialize(words.select(*keys).union(near.select(*keys)).distinct())
    # Candidates are narrowed; their scores are not: the scales are those of all items.
    hits = hybrid.minmax(lexical.lexical_hits(table, index.only(pairs)), table, index, scales)
    vectors = queries.select("query_id", "vector").join(pairs, "query_id")
    vectors = vectors.join(views.items(spark, sf).select("id", "embedding"), "id")
    cosines = vectors.select(*keys, cosine(F.col("vector"), F.col("embedding")).alias("cosine_score"))
    return hybrid.join_scores(pairs, hits, cosines)


def hybrid_join(spark, sf):
    rows = _joined_scores(spark, sf)
    return rows.withColumns({"bm25_score": r6("bm25_score"), "cosine_score": r6("cosine_score")})


def hybrid_fuse(spark, sf):
    return hybrid.fuse(_joined_scores(spark, sf)).select("query_id", "id", r6("score").alias("score"))


def _hybrid_result(found: DataFrame) -> DataFrame:
    names = ("score", "bm25_score", "cosine_score")
    return found.withColumns({n: r6(n) for n in names})


def search_hybrid(spark, sf):
    found = hybrid.search_hybrid(views.search_queries(spark, sf), views.index(spark, sf))
    return _hybrid_result(found)


def search_hybrid_filtered(spark, sf):
    queries = views.search_queries(spark, sf, filtered=True)
    return _hybrid_result(hybrid.search_hybrid(queries, views.index(spark, sf)))


def search_hybrid_alpha(spark, sf):
    index, queries = views.index(spark, sf), views.search_queries(spark, sf, filtered=True)
    parts = [
        hybrid.search_hybrid(queries, index, alpha=a).withColumn("alpha", F.lit(a)) for a in (0.0, 1.0)
    ]
    return _hybrid_result(parts[0].unionByName(parts[1]))


def search_hybrid_sparse(spark, sf):
    queries = views.search_queries(spark, sf, filtered=True)
    return _hybrid_result(hybrid.search_hybrid(queries, views.index(spark, sf), limits=NOTHING_SENT))


# --- lookups ----------------------------------------------------------------


def _asked_items(spark, sf):
    """Urls and names to look up, made from parts: right, wrong, other case, partial."""
    i = F.col("p_partkey")
    full = F.concat("p_name", F.lit(" "), "p_brand")
    return views.table(spark, sf, "part").select(
        i.alias("ref"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("https://catalog.example.com/view/"), i * 3, F.lit("/"))).alias("url"),
        F.when(i % 6 == 0, F.upper(full))
        .when(i % 6 == 1, F.substring(full, 3, 12))
        .when(i % 6 == 2, F.substring(full, 4, 5))
        .when(i % 6 == 3, F.substring(F.upper(full), 2, 2))
        .when(i % 6 == 4, F.lit(" "))
        .otherwise(F.concat(full, F.lit("%")))
        .alias("name"),
    )


def lookup_url(spark, sf):
    rows = lookup.lookup_by_url(_asked_items(spark, sf), views.catalog(spark, sf))
    return rows.select("url", "id", "name", joined("test_types").alias("test_types"))


def lookup_name_exact(spark, sf):
    return lookup.exact_names(_asked_items(spark, sf), views.catalog(spark, sf))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("needle", "id", "name", "url", joined("test_types").alias("test_types"))


def lookup_name(spark, sf):
    return _named(lookup.lookup_by_name(_asked_items(spark, sf), views.catalog(spark, sf)))


def lookup_name_stored(spark, sf):
    asked, stored = _asked_items(spark, sf), views.names(spark, sf)
    return _named(lookup.lookup_by_name(asked, views.catalog(spark, sf), stored))


def invalid_urls(spark, sf):
    return lookup.invalid_urls(_asked_items(spark, sf).select("ref", "url"), views.catalog(spark, sf))


def valid_urls(spark, sf):
    return lookup.valid_recommendations(_asked_items(spark, sf).select("ref", "url"), views.catalog(spark, sf))


def _repaired(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.size("recommendations").alias("n"), recs_text().alias("recommendations"))


def repair_recommendations(spark, sf):
    given = rsp.clean_responses(views.raw_responses(spark, sf))
    return _repaired(lookup.repair_recommendations(given, views.catalog(spark, sf)))


def repair_recommendations_stored(spark, sf):
    given = rsp.clean_responses(views.raw_responses(spark, sf))
    stored = views.names(spark, sf)
    return _repaired(lookup.repair_recommendations(given, views.catalog(spark, sf), stored=stored))


# --- conversations ----------------------------------------------------------


def _facts(spark, sf, copies=1, answered_only=False):
    return conv.facts_from_turns(views.chats(spark, sf, copies), views.SITE, answered_only)


def conversation_validate(spark, sf):
    return conv.validate_conversations(views.chats(spark, sf))


def latest_user_message(spark, sf):
    return conv.latest_user_message(_facts(spark, sf)).select("conv_id", "latest")


def user_context(spark, sf):
    return conv.user_context(_facts(spark, sf)).select("conv_id", "context")


def turn_limit(spark, sf):
    return conv.turn_limit(_facts(spark, sf, 3)).select("conv_id", "n_user", "over_limit")


def _flag(name):
    def query(spark, sf):
        return conv.message_flags(_facts(spark, sf)).select("conv_id", name)

    return query


def flag_prior(spark, sf):
    return _facts(spark, sf).select("conv_id", "prior")


def context_score(spark, sf):
    return conv.context_signals(_facts(spark, sf)).select("conv_id", "score")


def classify_intent(spark, sf):
    return conv.dialogue_state(_facts(spark, sf)).select("conv_id", "intent")


def intent_counts(spark, sf):
    return classify_intent(spark, sf).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def search_query(spark, sf):
    return conv.dialogue_state(_facts(spark, sf)).select("conv_id", "search_query")


def _found_filters(spark, sf):
    return conv.context_signals(_facts(spark, sf)).select("conv_id", "filters.*")


def extract_levels(spark, sf):
    return _found_filters(spark, sf).select("conv_id", joined("job_level").alias("job_level"))


def extract_adaptive(spark, sf):
    return _found_filters(spark, sf).select("conv_id", "adaptive")


def extract_duration(spark, sf):
    return _found_filters(spark, sf).select("conv_id", "duration_max")


def extract_filters(spark, sf):
    return _found_filters(spark, sf).withColumns(
        {"test_type": joined("test_type"), "job_level": joined("job_level")}
    )


def user_context_long(spark, sf):
    return conv.user_context(_facts(spark, sf, 3)).select("conv_id", "context")


def context_score_long(spark, sf):
    return conv.context_signals(_facts(spark, sf, 3)).select("conv_id", "score")


def classify_intent_long(spark, sf):
    return conv.dialogue_state(_facts(spark, sf, 3)).select("conv_id", "intent")


def search_query_long(spark, sf):
    return conv.dialogue_state(_facts(spark, sf, 3)).select("conv_id", "search_query")


def extract_filters_long(spark, sf):
    found = conv.context_signals(_facts(spark, sf, 3)).select("conv_id", "filters.*")
    return found.select("conv_id", joined("job_level").alias("job_level"), "adaptive", "duration_max")


def _processed(spark, sf, copies=1, responses=None):
    return plan.process_turns(
        _facts(spark, sf, copies, True), views.index(spark, sf), views.chat_encoder(), responses
    )


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id",
        "route",
        "reply",
        F.size("recommendations").alias("n"),
        recs_text().alias("recommendations"),
        "end_of_conversation",
    )


def process_turns(spark, sf):
    return _answers(_processed(spark, sf))


def process_turns_answered(spark, sf):
    return _answers(_processed(spark, sf, responses=views.raw_responses(spark, sf)))


def route_counts(spark, sf):
    return plan.route_counts(_facts(spark, sf, 3))


# --- prompts and responses --------------------------------------------------


def _contexts(spark, sf):
    routed = plan.route_conversations(_facts(spark, sf))
    items = plan.retrieve(routed, views.index(spark, sf), views.chat_encoder())
    return plan.turn_contexts(routed, items)


def catalog_context(spark, sf):
    return _contexts(spark, sf)


def prompt_messages(spark, sf):
    valid = conv.valid_facts(_facts(spark, sf)).select("conv_id")
    turns = spread_join(views.chats(spark, sf), valid, "conv_id", "left_semi")
    rows = ctx.build_prompts(turns, _contexts(spark, sf), views.INSTRUCTION)
    return rows.withColumn("content", F.md5("content"))


def recover_json(spark, sf):
    rows = rsp.recover_json(views.raw_responses(spark, sf))
    reply = F.coalesce(F.get_json_object("parsed", "$.reply"), F.get_json_object("parsed", "$.response"))
    return rows.select("conv_id", "attempt", reply.alias("reply"))


def normalize_response(spark, sf):
    rows = rsp.normalize_response(rsp.recover_json(views.raw_responses(spark, sf)))
    return rows.select(
        "conv_id", "is_object", "reply", recs_text().alias("recommendations"), "end_of_conversation"
    )


def response_fallback(spark, sf):
    rows = rsp.clean_responses(views.raw_responses(spark, sf))
    return rows.withColumn("recommendations", recs_text())


# --- evaluation -------------------------------------------------------------


def _predicted(spark, sf):
    index = views.index(spark, sf)
    asked = views.search_queries(spark, sf)
    found = hybrid.search_hybrid(asked, index).select("query_id", "rank", "id")
    rows = hybrid.with_details(found, index.catalog, few=query_table(asked).small)
    return rows.select("query_id", "rank", "url")


def _recalls(spark, sf):
    asked = views.search_queries(spark, sf)
    return ev.recall_at_k(asked, _predicted(spark, sf), views.truth(spark, sf))


def eval_schema_errors(spark, sf):
    rows = rsp.recover_json(views.raw_responses(spark, sf))
    found = ev.schema_errors(rows.select("conv_id", F.coalesce("parsed", "raw").alias("response")))
    return found.select("conv_id", joined("errors").alias("errors"))


def eval_url_errors(spark, sf):
    rows = rsp.clean_responses(views.raw_responses(spark, sf))
    return ev.url_errors(rows, views.catalog(spark, sf))


def eval_recall(spark, sf):
    return _recalls(spark, sf).withColumn("recall", r6("recall"))


def eval_mean_recall(spark, sf):
    return ev.mean_recall(_recalls(spark, sf)).withColumn("mean_recall", r6("mean_recall"))


def eval_hits(spark, sf):
    return ev.hits(_predicted(spark, sf), views.truth(spark, sf))


def eval_misses(spark, sf):
    return ev.misses(_predicted(spark, sf), views.truth(spark, sf))


def eval_hit_table(spark, sf):
    return ev.hit_table(_predicted(spark, sf), views.truth(spark, sf))


def eval_probes(spark, sf):
    facts = conv.facts_from_turns(views.probe_chats(spark, sf), views.SITE)
    rows = plan.process_turns(facts, views.index(spark, sf), views.chat_encoder())
    return ev.run_probes(rows, views.probes(spark, sf))


def _summary(spark, sf, rows):
    result = evaluate(materialize(rows), views.chat_truth(spark, sf), views.catalog(spark, sf))
    return result.withColumn("mean_recall", r6("mean_recall"))


def eval_summary(spark, sf):
    return _summary(spark, sf, _processed(spark, sf, responses=views.raw_responses(spark, sf)))


def eval_summary_unrepaired(spark, sf):
    return _summary(spark, sf, rsp.clean_responses(views.raw_responses(spark, sf)))


# --- streaming --------------------------------------------------------------


def stream_process_turns(spark, sf):
    base = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    folded = src.fold_conversations(views.chats(spark, sf)).select("conv_id", "messages")
    folded.write.parquet(f"{base}/requests")
    process_stream(
        src.stream_requests(spark, f"{base}/requests"),
        views.index(spark, sf),
        views.chat_encoder(),
        f"{base}/answers",
        f"{base}/state",
        views.SITE,
    ).awaitTermination()
    return _answers(spark.read.parquet(f"{base}/answers"))


def stream_process_turns_answered(spark, sf):
    """Two starts of the stream; some texts come in the second for requests of the first."""
    base = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    events = {"requests": views.timed_requests(spark, sf), "responses": views.timed_responses(spark, sf)}
    first, last = views.table(spark, sf, "conversations").agg(F.min("conv_id"), F.max("conv_id")).first()
    times = {"requests": "asked_at", "responses": "given_at"}
    cut = views.made_at(F.lit((first + last) // 2))
    beat = spark.range(1).select(views.made_at(F.lit(last + 86400)).alias("asked_at"))
    beats = {"requests": beat, "responses": beat.select(F.col("asked_at").alias("given_at"))}
    for part in range(2):
        for name, rows in events.items():
            here = rows.where(F.col(times[name]) < cut if part == 0 else F.col(times[name]) >= cut)
            if part:
                here = here.unionByName(beats[name], allowMissingColumns=True)
            here.write.mode("append").parquet(f"{base}/{name}")
        process_answered_stream(
            src.stream_timed_requests(spark, f"{base}/requests"),
            src.stream_responses(spark, f"{base}/responses"),
            views.index(spark, sf),
            views.chat_encoder(),
            f"{base}/answers",
            f"{base}/state",
            views.SITE,
        ).awaitTermination()
    return _answers(spark.read.parquet(f"{base}/answers"))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_scan,
        catalog_ingest,
        conversation_fold,
        response_emit,
        catalog_coerce,
        recommendation_view,
        detail_view,
        catalog_urls,
        filter_test_type,
        filter_job_level,
        filter_remote,
        filter_adaptive,
        filter_duration,
        filter_combined,
        filter_per_query,
        lexical_match_all,
        lexical_tokens,
        lexical_index,
        lexical_term_stats,
        lexical_score,
        search_lexical,
        search_lexical_stored,
        search_lexical_any,
        vector_normalize,
        text_encode,
        vector_cosine,
        search_vector,
        search_vector_filtered,
        search_vector_grid,
        search_vector_cells,
        search_vector_kmeans,
        search_vector_stored_cells,
        hybrid_minmax,
        hybrid_join,
        hybrid_fuse,
        search_hybrid,
        search_hybrid_filtered,
        search_hybrid_alpha,
        search_hybrid_sparse,
        lookup_url,
        lookup_name_exact,
        lookup_name,
        lookup_name_stored,
        invalid_urls,
        valid_urls,
        repair_recommendations,
        repair_recommendations_stored,
        conversation_validate,
        latest_user_message,
        user_context,
        turn_limit,
        flag_prior,
        context_score,
        classify_intent,
        intent_counts,
        search_query,
        extract_levels,
        extract_adaptive,
        extract_duration,
        extract_filters,
        user_context_long,
        context_score_long,
        classify_intent_long,
        search_query_long,
        extract_filters_long,
        process_turns,
        process_turns_answered,
        route_counts,
        catalog_context,
        prompt_messages,
        recover_json,
        normalize_response,
        response_fallback,
        eval_schema_errors,
        eval_url_errors,
        eval_recall,
        eval_mean_recall,
        eval_hits,
        eval_misses,
        eval_hit_table,
        eval_probes,
        eval_summary,
        eval_summary_unrepaired,
        stream_process_turns,
        stream_process_turns_answered,
    )
}
QUERIES.update({f"flag_{n}": _flag(n) for n in ("refuse", "compare", "refine", "confirm")})

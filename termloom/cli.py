"""Command line: ``python -m termloom.cli <program> ...``.

Programs: profiles, string-network, rank, suggest, match-report,
match, index-corpus, remote.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import strings
from termloom.operators import cluster, compare, graph, items, profiles, report, search, suggest, textindex
from termloom.operators.ontology import Ontology
from termloom.session import session
from termloom.sources import sinks, tables, text


def comma_list(s: str) -> list[str]:
    return s.split(",")


def columns(s: str) -> list[int]:
    """Column numbers, counted from 1 on the command line."""
    return [int(x) - 1 for x in s.split(",")]


def lists(s: str) -> dict[str, list[str]]:
    """``p(a,b)n(c)``: white (p) and black (n) lists."""
    out: dict[str, list[str]] = {"p": [], "n": []}
    for kind, ids in re.findall(r"([pn])\(([\w:,]*)\)", s):
        out[kind] += [x for x in ids.split(",") if x]
    return out


def children(s: str) -> tuple[list[str], str]:
    """``modifiers/term,term`` or ``term,term``."""
    head, _, tail = s.rpartition("/")
    return tail.split(","), head


def keyword_fields(s: str) -> tuple[str, list[str]]:
    word, _, fields = s.partition("|")
    return word, fields.split(",") if fields else ["name", "synonym", "def"]


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termloom")
    top.add_argument("--master")
    sub = top.add_subparsers(dest="program", required=True)

    def program(name: str, *flags: tuple) -> None:
        p = sub.add_parser(name)
        for names, options in flags:
            p.add_argument(*names.split(), **options)

    s, on = dict(default=None), dict(action="store_true")
    i = lambda d: dict(type=int, default=d)
    f = lambda d: dict(type=float, default=d)
    program(
        "profiles",
        ("-i --input_file", s), ("-o --output_file", s), ("-O --ontology_file", dict(required=True)), ("-p --processes", i(0)), ("-d --download", s), ("-I --IC", s), ("-T --term_filter", s), ("-t --translate", s),
        ("-s --similarity_method", s), ("--reference_profiles", s), ("-c --clean_profiles", on), ("-r --removed_path", dict(default="rejected_profs")), ("-u --untranslated_path", s), ("-k --keyword", s),
        ("-e --expand_profiles", dict(default=None, choices=["parental", "propagate"])), ("-U --unwanted_terms", dict(type=comma_list, default=[])), ("-S --separator", dict(default=";")), ("-E --external_separator", s), ("-n --statistics", on), ("-l --list_translate", s),
        ("-F --filter_list", dict(type=lists, default=None)), ("-q --query_ncbi", s), ("-f --subject_column", i(0)), ("-a --annotations_column", i(1)), ("--list_term_attributes", on), ("-R --root", s),
        ("--xref_sense", dict(action="store_const", const="byTerm", default="byValue")), ("-C --childs", dict(type=children, default=None)), ("--keyword_search", dict(type=keyword_fields, default=None)),
        ("--translate_keyword_search", on), ("--list", dict(action="store_true", dest="simple_list")), ("--2cols", dict(action="store_true", dest="two_cols")), ("--out2cols", on), ("--profiles_self_similarities", s),
        ("--profiles_self_similarities_output", dict(default="profiles_self_similarities.txt")), ("--output_report", s), ("--root_term", s), ("--ref_term", s), ("--similarity_cluster_plot", s), ("--cl_size_factor", f(1.0)),
        ("--ontoplot_mode", dict(default="static", choices=["static", "dynamic"])), ("--skip_count_parentals", dict(action="store_false", dest="count_parentals")), ("--onto_min_freq", f(0.005)), ("--load_hard_cleaned_profiles", on),
        ("--return_all_terms_with_user_defined_attributes", dict(type=comma_list, default=None)),
    )
    program(
        "string-network",
        ("-i --input_file", dict(required=True)), ("-o --output_file", dict(required=True)), ("-s --split_char", dict(default="\t")), ("-c --columns", dict(type=columns, default=[0])), ("-C --filter_column", i(-1)),
        ("-f --filter_value", s), ("-r --remove_chars", dict(default="")), ("--sim_algorithm", dict(default="white")),
    )
    program(
        "rank",
        ("-i --input_file", dict(required=True)), ("-o --output_file", dict(default="report.html")), ("-d --pat_id_col", i(0)), ("-p --term_col", i(1)), ("-S --terms_separator", dict(default="|")), ("-r --ref_profile", s),
        ("-O --ontology_file", dict(required=True)), ("-X --excluded_terms", s), ("--hard_check", dict(action="store_false")), ("-f --general_prof_freq", f(0.0)), ("-L --matrix_limits", dict(type=comma_list, default=["20", "40"])),
        ("--header_id", dict(default="HP")),
    )
    program(
        "suggest",
        ("-q --query_terms", dict(required=True)), ("-O --ontology_file", dict(required=True)), ("-r --term_relations", dict(required=True)), ("-o --output_file", dict(required=True)), ("-m --max_targets", i(0)),
        ("-t --translate", dict(default="c", choices=["c", "n", "cn", "nc"])), ("-b --black_list", s), ("-d --deleted_terms", s), ("-f --filter_parental_targets", on), ("-c --clean_query_terms", on),
        ("-T --transform_rel_values", dict(default="no", choices=["no", "exp", "log10"])), ("--output_report", s), ("--heatmap_color_preset", dict(default="1", choices=["1"])),
    )
    program(
        "match",
        ("-q --query", dict(required=True)), ("-c --corpus", dict(required=True)), ("-o --output_file", dict(required=True)), ("-m --model_name", s), ("-p --model_path", s), ("-Q --query_embedded", s), ("-C --corpus_embedded", s),
        ("-k --top_k", i(20)), ("-t --threshold", f(0.0)), ("-v --verbose", on), ("-g --gpu_device", dict(type=comma_list, default=[])), ("-b --batch_size", i(0)), ("--use_gpu_for_sim_calculation", on), ("-s --split", on),
        ("--order", dict(default="corpus-query")), ("--chunk_size", i(0)), ("--print_relevant_pairs", on),
    )
    program(
        "match-report",
        ("-i --input_file", dict(required=True)), ("-O --ontology", dict(required=True)), ("-r --ref_profile", dict(required=True)), ("-o --output_file", dict(default="report.html")), ("-d --id_col", i(0)),
        ("-p --profiles_col", i(1)), ("-S --separator", dict(default="|")), ("-L --matrix_limits", dict(type=comma_list, default=["20", "40"])), ("-N --neg_matrix_limits", dict(type=comma_list, default=["20", "40"])),
        ("--hard_check", dict(action="store_false")), ("--pubmed_ids_and_titles", s), ("--sim", dict(default="lin")), ("--use_pickle", on), ("--get_full_sim_sorted_list", on),
    )
    program(
        "index-corpus",
        ("-i --input", dict(required=True)), ("-o --output", dict(required=True)), ("-k --items_per_file", i(0)), ("-t --tag", s), ("-c --n_cpus", i(0)), ("-z --chunk_size", i(0)),
        ("-b --text_balancing_size", i(0)), ("-d --debugging_mode", on), ("-s --split", on), ("--split_output_files", on), ("-p --parse", dict(default="Basic", choices=["PubmedPaper", "PubmedAbstract", "Basic"])),
        ("-e --equivalences_file", s), ("-f --filter_by_blacklist", s), ("--blacklisted_mode", dict(default="partial")), ("--clean_type", dict(default="hard")), ("--split_type", dict(default="classic")),
    )
    program("remote", ("-i --input_file", s), ("-s --source", s), ("-o --output_file", s))
    return top


def _tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False)


def _read_lines(path: str) -> list[str]:
    with open(path) as f:
        return [x.strip() for x in f if x.strip()]


def _ids(spark, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term_id string")


def _offline(*_) -> None:
    raise SystemExit("remote services are not reachable from this program; read local files instead")


def _ontology(spark, name: str, black_list: list[str] | None = None) -> Ontology:
    """The ontology of a file, or of a name that the folder in TERMLOOM_ONTOLOGIES holds as
    ``name.obo``, ``name.obo.gz`` or ``name.json``."""
    folder = os.environ.get("TERMLOOM_ONTOLOGIES")
    known = [f"{folder}/{name}{end}" for end in (".obo", ".obo.gz", ".json")] if folder else []
    path = name if "://" in name or os.path.exists(name) else next((x for x in known if os.path.exists(x)), None)
    if path is None:
        raise SystemExit(f"{name} is neither a file nor an ontology in TERMLOOM_ONTOLOGIES")
    return Ontology.from_json(spark, path) if path.endswith(".json") else Ontology.from_obo(spark, path, black_list)


def _plot(onto: Ontology, prof: DataFrame, o) -> DataFrame:
    """The places of the ontology's plot: below the wanted root, at the wanted frequency; in the
    dynamic mode with the names to show."""
    roots = report.default_root((onto.header.select("ont_name").first() or [""])[0] or "") if onto.header is not None else None
    root = o.root_term or (roots[0] if roots else graph.roots(onto.term, onto.closure).select("term_id").orderBy("term_id").first()[0])
    freq = profiles.term_frequencies(prof, onto.closure if o.count_parentals else None, min_freq=o.onto_min_freq, distinct=True)
    places = report.ontoplot(onto.paths, onto.level, freq, root).withColumn("guide", F.col("term_id") == F.lit(o.ref_term or (roots[1] if roots else root)))
    return places.join(onto.term.select("term_id", "name"), "term_id") if o.ontoplot_mode == "dynamic" else places


def profiles_program(spark, o) -> None:
    if o.download or o.query_ncbi:
        _offline()
    onto = _ontology(spark, o.ontology_file)
    if o.root:
        onto = onto.reroot(o.root)
    prof = None
    if o.input_file and not o.list_translate and not o.filter_list:
        if o.simple_list:  # each line is a term of its own
            prof = tables.read_list(spark, o.input_file).select(F.col("pos").cast("string").alias("profile_id"), F.lit(0).alias("pos"), F.col("text").alias("term_id"))
        else:
            prof = tables.read_profiles(spark, o.input_file, o.subject_column, o.annotations_column, o.separator, o.two_cols)
        if o.load_hard_cleaned_profiles:
            prof = profiles.clean_hard(prof, onto.term, onto.alt, onto.closure, o.term_filter)
    if o.list_translate:
        names = tables.read_list(spark, o.input_file).withColumnRenamed("text", "name")
        _tsv(onto.ids_of(names).select("name", "term_id") if o.list_translate == "names" else onto.names_of(names.withColumnRenamed("name", "term_id")).select("term_id", "name"), o.output_file)
    elif o.filter_list:
        terms = tables.read_list(spark, o.input_file).select(F.col("text").alias("term_id"))
        _tsv(profiles.filter_terms(terms, onto.closure, o.filter_list["p"], o.filter_list["n"]), o.output_file)
    if prof is not None:
        if o.translate == "codes":
            named = onto.ids_of(prof.withColumnRenamed("term_id", "name")).select("profile_id", "pos", "name", "term_id")
            if o.untranslated_path:
                _tsv(named.where("term_id is null").select("profile_id", "name"), o.untranslated_path)
            prof = named.where("term_id is not null").select("profile_id", "pos", "term_id")
        if o.clean_profiles:
            good, bad = profiles.check_ids(prof, onto.term, onto.alt)
            _tsv(bad.select("profile_id", "term_id"), o.removed_path)
            prof = profiles.clean_hard(good, onto.term, onto.alt, onto.closure, o.term_filter)
        if o.expand_profiles:
            if o.expand_profiles == "parental":
                wide = profiles.expand_with_parents(prof, onto.closure, o.unwanted_terms)
            else:
                risen = items.expand_to_parents(prof.select("term_id", F.col("profile_id").alias("item_id")), onto.closure, onto.level, 1)
                wide = risen.select(F.col("item_id").alias("profile_id"), "term_id")
                wide = wide.where(~F.col("term_id").isin(*o.unwanted_terms)) if o.unwanted_terms else wide
            prof = profiles.from_pairs(wide, "profile_id", "term_id", "term_id")
        if o.IC:
            _tsv(profiles.mean_ics(prof, onto.ic("resnik", "resnik_observed", profile=prof), ["ic_resnik", "ic_resnik_observed"]), o.IC)
        if o.similarity_method:
            ref = tables.read_profiles(spark, o.reference_profiles, sep=o.separator) if o.reference_profiles else None
            sims = compare.compare_profiles(prof, onto.term_similarities(prof, ref, o.similarity_method), ref)
            sinks.write_pairs(sims, f"{o.output_file}_{o.similarity_method}")
            if o.similarity_cluster_plot:
                groups, _, tree = cluster.cluster_profiles(sims, o.similarity_method, size_factor=o.cl_size_factor)
                _tsv(groups, f"{o.output_file}_clusters")
                with open(f"{o.output_file}.dnd", "w") as out:
                    out.write(tree)
        if o.profiles_self_similarities:
            _tsv(compare.self_similarities(prof, onto.term_similarities(prof, sim_type=o.profiles_self_similarities)), o.profiles_self_similarities_output)
        if o.statistics:
            _tsv(profiles.size_stats(prof), f"{o.output_file}_stats")
        if o.translate == "names":
            _tsv(profiles.translated(prof, onto.term).select("profile_id", F.array_join("names", o.separator)), o.output_file)
        elif o.output_file and not o.similarity_method:
            sinks.write_profiles(prof, o.output_file, o.external_separator or o.separator, o.out2cols)
        if o.output_report:
            freq = profiles.term_frequencies(prof, onto.closure if o.count_parentals else None)
            sinks.write_report(o.output_report, "Profiles", {"levels": profiles.level_distribution(prof, onto.level), "terms": report.frequency_table(freq, onto.term, o.onto_min_freq), "redundancy": report.redundancy_table(profiles.redundancy(prof, onto.closure)), "plot": _plot(onto, prof, o)})
    if o.childs:
        terms, mods = o.childs
        seeds, up = _ids(spark, terms), "a" in mods
        hop = re.search(r"h(\d+)", mods)
        if "r" in mods:
            found = graph.child_relations(onto.edge, onto.closure, onto.level, seeds, up, int(hop[1]) if hop else None)
        else:
            found = graph.familiar(onto.closure, seeds, up).select(F.col("related").alias("term_id")).distinct()
            if "CNS" in mods:
                found = found.join(onto.attributes(), "term_id").select("term_id", "name", "synonyms")
            elif "n" in mods:
                found = found.join(onto.term, "term_id").select("name")
            elif "s" in mods:
                found = found.join(onto.level, "term_id").orderBy(F.desc("level") if up else F.asc("level"), "term_id").select("term_id")
        _tsv(found, o.output_file)
    if o.keyword:
        d = onto.dictionary("xref", o.keyword).select("term_id", "value")
        _tsv(d.select("value", "term_id") if o.xref_sense == "byValue" else d, o.output_file)
    if o.keyword_search:
        hits = onto.search(o.keyword_search[0], tuple(o.keyword_search[1]))
        _tsv(hits.join(onto.term, "term_id").select("term_id", "name") if o.translate_keyword_search else hits, o.output_file)
    if o.list_term_attributes:
        _tsv(onto.attributes(), f"{o.output_file}_term_attributes")
    if o.return_all_terms_with_user_defined_attributes:
        values = [F.array_join(F.coalesce(F.try_element_at("tags", F.lit(t)), F.array().cast("array<string>")), "|").alias(t) for t in o.return_all_terms_with_user_defined_attributes]
        _tsv(onto.term.select("term_id", *values), o.output_file)


def network_program(spark, o) -> None:
    rows = tables.read_table(spark, o.input_file, o.columns, o.split_char, o.filter_column, o.filter_value)
    _tsv(strings.similarity_network(rows, o.sim_algorithm, remove=o.remove_chars), o.output_file)


def rank_program(spark, o) -> None:
    onto = _ontology(spark, o.ontology_file, _read_lines(o.excluded_terms) if o.excluded_terms else None)
    prof = tables.read_profiles(spark, o.input_file, o.pat_id_col, o.term_col, o.terms_separator)
    if o.hard_check:
        prof = profiles.clean_hard(prof, onto.term, onto.alt, onto.closure)
    if o.ref_profile:
        ref = _ids(spark, _read_lines(o.ref_profile))
    else:
        ref = profiles.general_profile(prof, onto.term, onto.alt, onto.closure, o.general_prof_freq)
    ref = profiles.from_pairs(ref.withColumn("profile_id", F.lit("ref")), "profile_id", "term_id", "term_id")
    _ranking(onto, ref, prof, o, o.matrix_limits, "lin", None, o.header_id, True)


def _ranking(onto, ref: DataFrame, prof: DataFrame, o, low_limits: list[str], kind: str, titles: DataFrame | None, header: str, whole: bool) -> None:
    """The report of candidates by likeness to the reference; ``whole`` also writes all of them."""
    terms, candidates = map(int, o.matrix_limits)
    sims = onto.term_similarities(ref, prof, kind)
    ranked = compare.rank_candidates(compare.compare_profiles(ref, sims, prof, bidirectional=False), "ref")
    if whole:
        _tsv(ranked, f"{o.output_file}.tsv")
    top = ranked.orderBy("rank").limit(candidates)
    held = prof.join(top.select(F.col("candidate").alias("profile_id")), "profile_id", "left_semi")
    low = compare.candidate_term_sims(ref, held, sims)
    matrix = compare.term_matrix(compare.term_matches(ref, held, sims), top, terms).withColumnRenamed("ref_term", header)
    negative = compare.negative_terms(low, term_limit=int(low_limits[0]))
    first = top.orderBy("rank").limit(int(low_limits[-1])).select("candidate")
    cells = compare.negative_matrix(low.join(first, "candidate", "left_semi"), negative)
    shown = top if titles is None else report.document_report(top.withColumnRenamed("candidate", "doc_id"), titles).orderBy("rank")
    sinks.write_report(o.output_file, "Ranked profiles", {"candidates": shown, "matrix": matrix, "not in the reference": negative, "held by": cells})


def suggest_program(spark, o) -> None:
    onto = _ontology(spark, o.ontology_file)
    query = _ids(spark, sorted(set(_read_lines(o.query_terms))))
    if o.clean_query_terms:
        one = query.select(F.lit("q").alias("profile_id"), F.lit(0).alias("pos"), "term_id")
        query = profiles.clean_hard(one, onto.term, onto.alt, onto.closure).select("term_id")
    excluded = graph.familiar(onto.closure, query, up=True).select(F.col("related").alias("term_id")) if o.filter_parental_targets else None
    black = _ids(spark, _read_lines(o.black_list)) if o.black_list else None
    out = suggest.suggestions(tables.read_relations(spark, o.term_relations), query, black, excluded, o.max_targets, o.transform_rel_values)
    cells = out["cells"]
    if o.translate != "c":
        for c in ("query", "target"):
            n = onto.term.select(F.col("term_id").alias(c), F.col("name").alias("_n"))
            shown = {"n": F.col("_n"), "cn": F.format_string("(%s) %s", F.col(c), F.col("_n")), "nc": F.format_string("%s (%s)", F.col("_n"), F.col(c))}[o.translate]
            cells = cells.join(n, c, "left").withColumn(c, F.coalesce(shown, F.col(c))).drop("_n")
    _tsv(report.heatmap(cells, "query", "target", "value", 1000), o.output_file)
    if o.deleted_terms:
        _tsv(query.join(out["means"].select(F.col("query").alias("term_id")), "term_id", "left_anti"), o.deleted_terms)
    if o.output_report:
        sinks.write_report(o.output_report, "Suggestions", {"targets": out["targets"], "queries": out["means"]})


def _model(o) -> search.Embedder:
    """The embedder of the flags: a sentence model if one is named, else hashed words."""
    if o.gpu_device or o.use_gpu_for_sim_calculation:
        raise SystemExit("vectors are made and compared on the executors' CPUs; leave the GPU flags out")
    if not (o.model_name or o.model_path):
        return search.hashing_embedder()
    try:
        import sentence_transformers
    except ImportError as e:
        raise SystemExit("--model_name and --model_path need the package sentence_transformers") from e
    name = os.path.join(o.model_path, o.model_name or "") if o.model_path else o.model_name

    def make():
        model = sentence_transformers.SentenceTransformer(name)
        return lambda texts: model.encode(texts, batch_size=o.batch_size or 32)

    return make


def _vectors(spark, path: str | None, make) -> DataFrame:
    """Vectors saved at ``path`` if there are any; else those that are made, saved there."""
    if path and os.path.exists(path):
        return spark.read.parquet(path)
    made = make()
    if path:
        made.write.parquet(path)
        return spark.read.parquet(path)
    return made


def match_program(spark, o) -> None:
    """Keyword files (several separated by commas) against a corpus; vectors can be saved."""
    if o.verbose:
        spark.sparkContext.setLogLevel("INFO")
    if o.chunk_size:  # texts that a worker holds at once
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", o.chunk_size)
    model = _model(o)
    corpus = _vectors(spark, o.corpus_embedded, lambda: search.embed_texts(tables.read_corpus(spark, o.corpus, o.split), model))
    files = o.query.split(",")
    saved = o.query_embedded.split(",") if o.query_embedded else [None] * len(files)
    if len(saved) != len(files):
        raise SystemExit("--query_embedded names as many folders as --query names files")
    for path, at in zip(files, saved):
        words = _vectors(spark, at, lambda path=path: search.embed_keywords(tables.read_keywords(spark, path), model))
        found = search.match(words, corpus, o.top_k, o.threshold, o.order)
        sinks.write_matches(found, o.output_file, o.threshold, o.order)
        if o.print_relevant_pairs:
            for r in search.relevant_pairs(found, words, o.threshold).limit(50).collect():
                print(f"{r['terms']}\t{r['score']:.4f}\t{r['text_ids']}")


def match_report_program(spark, o) -> None:
    if o.use_pickle:
        raise SystemExit("pickled files run code when they are opened; give a table instead of --use_pickle")
    onto = _ontology(spark, o.ontology)
    prof = tables.read_profiles(spark, o.input_file, o.id_col, o.profiles_col, o.separator)
    if not o.hard_check:
        prof = profiles.clean_hard(prof, onto.term, onto.alt, onto.closure)
    ref = profiles.from_pairs(_ids(spark, _read_lines(o.ref_profile)).withColumn("profile_id", F.lit("ref")), "profile_id", "term_id", "term_id")
    titles = spark.read.csv(o.pubmed_ids_and_titles, sep="\t", schema="doc_id string, title string, article_type string, article_category string") if o.pubmed_ids_and_titles else None
    _ranking(onto, ref, prof, o, o.neg_matrix_limits, o.sim, titles, "HP", o.get_full_sim_sorted_list)


def index_program(spark, o) -> None:
    if o.debugging_mode:
        spark.sparkContext.setLogLevel("INFO")
    if o.chunk_size:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", o.chunk_size)
    kind = {"PubmedPaper": "paper", "PubmedAbstract": "abstract", "Basic": "basic"}[o.parse]
    records = text.read_records(spark, o.input, kind, o.clean_type)
    eq = spark.read.csv(o.equivalences_file, sep="\t", schema="pmc string, pmid string") if o.equivalences_file else None
    words = _read_lines(o.filter_by_blacklist) if o.filter_by_blacklist else None
    rows = textindex.usable(records, kind, eq, words, o.blacklisted_mode)
    to = f"{o.output}/{o.tag}" if o.tag else o.output
    sinks.write_corpus(textindex.prepare(rows, o.split, o.split_type), to, o.items_per_file, o.text_balancing_size, o.split_output_files)


PROGRAMS = {
    "profiles": profiles_program,
    "string-network": network_program,
    "rank": rank_program,
    "suggest": suggest_program,
    "match-report": match_report_program,
    "match": match_program,
    "index-corpus": index_program,
    "remote": _offline,
}


def main(args: list[str] | None = None) -> None:
    o = _parser().parse_args(args)
    cores = getattr(o, "processes", 0) or getattr(o, "n_cpus", 0)
    spark = session(o.master or f"local[{cores or '*'}]")
    spark.sparkContext.setLogLevel("ERROR")
    PROGRAMS[o.program](spark, o)


if __name__ == "__main__":
    main(sys.argv[1:])

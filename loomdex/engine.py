"""The index object: one Spark session, one base folder, ingest, search and administration on top."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.clauses import Clause
from loomdex.functions.codes import check_bits, stored_ratio, survivors
from loomdex.functions.embed import Embedder, HashEmbedder, embed_one
from loomdex.functions.format import hit_text
from loomdex.functions.querytext import parse_query, plain_terms
from loomdex.operators import docstore
from loomdex.operators import registry as reg
from loomdex.operators.bm25 import candidate_budget, rank_postings
from loomdex.operators.blockmax import rank_blocks
from loomdex.operators.filters import metadata_filter
from loomdex.operators.lookup import rank_clause_postings
from loomdex.operators.vector import rank_allowed
from loomdex.plans import sync as syncing
from loomdex.plans.convert import convert, tree, with_quality, write_images, write_tree
from loomdex.plans.hybrid import parent_chunks, with_context
from loomdex.plans.repair import Rewriter, repair
from loomdex.schemas import REMOVED
from loomdex.sources.docx import read_docx
from loomdex.sources.files import plain_path, read_files
from loomdex.sources.pdf import PdfReader, pymupdf_reader
from loomdex.sources.tables import materialize
from loomdex.store import Store, term_bucket


#: Extensions of the files that are converted before they are indexed.
OFFICE = (".docx", ".pdf")
#: Fields that query texts may name.
QUERY_FIELDS = ("title", "content", "department", "date", "filepath", "chunk_type")


class SearchIndex:
    """Hybrid document index.

    Searches return DataFrames whose stages are joined inside Spark; only the query itself is embedded on the driver.
    ``dim`` fixes the length of all vectors; without it the first committed vectors do. ``bit_width`` is the number of bits that a
    component has in the codes that full vector searches scan.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        embedder: Embedder | None = None,
        *,
        bit_width: int = 4,
        dim: int | None = None,
        pdf_reader: PdfReader = pymupdf_reader,
    ):
        self.spark = spark
        self.store = Store(spark, base)
        self.embedder = embedder or HashEmbedder()
        self.bit_width = check_bits(bit_width)
        self.dim = dim
        self.pdf_reader = pdf_reader
        self._stats: dict = {}

    # ingest

    def add_document(self, path: str) -> int:
        """Index one file and return the id of its first chunk."""
        files = read_files(self.spark, [path])
        if files.select("file_path").isEmpty():
            raise FileNotFoundError(f"document not found: {path}")
        before = self.store.refresh().max_id
        syncing.ingest(self.store, files, self.embedder, dim=self.dim, bit_width=self.bit_width, pdf_reader=self.pdf_reader)
        # new chunks take the ids after those given out before, so only this version's files are read
        own = self.chunks().where((F.col("doc_id") > before) & (F.col("filepath") == plain_path(path)))
        first = own.agg(F.min("doc_id")).first()[0]
        if first is None:
            first = self.chunks().where(F.col("filepath") == plain_path(path)).agg(F.min("doc_id")).first()[0]
        if first is None:
            raise ValueError(f"document has no indexable content: {path}")
        return first

    def sync_from_config(self, config: Mapping) -> dict[str, int]:
        """Incremental pass over ``watch_dirs``; failed files are listed by :meth:`errors`.

        With ``auto_convert_office: false`` office files are left out. With ``converted_md_dir`` the Markdown tree of
        all office files is written there.
        """
        directories = [d for d in config.get("watch_dirs") or [] if d]
        extensions, ignore = config.get("supported_extensions", [".md"]), config.get("ignore_patterns") or []
        office = [e for e in extensions if e.lower() in OFFICE]
        if not config.get("auto_convert_office", True):
            extensions = [e for e in extensions if e not in office]
        elif office and config.get("converted_md_dir"):
            self.convert(directories, config["converted_md_dir"], extensions=office, ignore=ignore)
        return syncing.sync(
            self.store,
            directories,
            extensions,
            ignore,
            self.embedder,
            dim=self.dim,
            bit_width=self.bit_width,
            pdf_reader=self.pdf_reader,
        )

    def remove_file(self, path: str) -> int:
        """Hide all chunks of one file in every layer and forget the file; returns the number of chunks."""
        path = plain_path(path)
        head = self.store.refresh()
        at = self.store.ranges().where(F.col("file_path") == path).first()
        if at is None:
            ids = self.chunks().select("doc_id").where(F.lit(False))
        else:
            ids = self.chunks().where(F.col("doc_id").between(at["first_id"], at["last_id"])).select("doc_id")
        known = self.store.registry().where(F.col("file_path") == path)
        found = ids.count()
        if not found and known.isEmpty():
            return 0
        version = head.version + 1
        self.store.write("removed", version, ids)
        self.store.write("registry", version, reg.remove(self.store.registry(), known))
        self.store.commit(version, {"deleted": 1}, max_id=head.max_id)
        return found

    def remove_document(self, doc_id: int) -> bool:
        """Hide one chunk in every layer; False when there is no such chunk."""
        known = self.get_content(doc_id)
        if known is None:
            return False
        head = self.store.refresh()
        version = head.version + 1
        self.store.write("removed", version, self.spark.createDataFrame([(doc_id,)], REMOVED))
        left = F.when(F.col("file_path") == known["filepath"], F.col("chunk_count") - 1).otherwise(F.col("chunk_count"))
        self.store.write("registry", version, self.store.registry().withColumn("chunk_count", left.cast("int")))
        self.store.commit(version, {"deleted": 0}, max_id=head.max_id)
        return True

    # search

    def bm25_candidates(
        self, query: str, filters: Mapping | None = None, limit: int = 100, *, field: str = "content", mode: str = "and",
        filter_mode: str = "post",
    ) -> DataFrame:
        """``doc_id, bm25`` of the top ``limit`` chunks for a query text; ``post`` filters drop rows of that top.

        :mod:`loomdex.functions.querytext` tells the syntax; a text that breaks it is an error. ``mode`` joins words side by side.
        """
        clause = parse_query(query, QUERY_FIELDS, mode)
        terms = plain_terms(clause, mode)
        if terms is None:  # more than words side by side
            return self._find_filtered(clause, filters, limit, field, filter_mode)
        row = self._corpus_stats(field)
        buckets = [term_bucket(F.lit(t)) for t in terms]
        post = self.store.layer("postings").where(F.col("field") == field)
        if buckets:
            post = post.where(F.col("bucket").isin(buckets))
        if filters and filter_mode == "pre":
            wanted = self.chunks().where(metadata_filter(filters)).select("doc_id")
            ranked = rank_postings(post, row[0], row[1] or 1.0, terms, limit, mode=mode, allowed=wanted)
        elif (blocks := self.store.blocks()) is not None and buckets:
            bounds = blocks.where((F.col("field") == field) & F.col("bucket").isin(buckets))
            ranked = rank_blocks(post, bounds, row[0], row[1] or 1.0, terms, limit, mode=mode)
        else:
            ranked = rank_postings(post, row[0], row[1] or 1.0, terms, limit, mode=mode)
        return self._keep(ranked, filters) if filters and filter_mode == "post" else ranked

    def _keep(self, ranked: DataFrame, filters: Mapping) -> DataFrame:
        meta = self.chunks().select("doc_id", "department", "date").where(metadata_filter(filters))
        return ranked.join(meta.select("doc_id"), "doc_id").select("doc_id", "bm25").orderBy(F.desc("bm25"), "doc_id")

    def _find_filtered(self, clause: Clause, filters: Mapping | None, limit: int, field: str, filter_mode: str) -> DataFrame:
        if not filters:
            return self.find(clause, limit, field=field)
        if filter_mode == "post":
            return self._keep(self.find(clause, limit, field=field), filters)
        wanted = self.chunks().where(metadata_filter(filters)).select("doc_id")
        return self.find(clause, limit, field=field, allowed=wanted)

    def find(self, clause: Clause | str, limit: int = 100, *, field: str = "content", allowed: DataFrame | None = None) -> DataFrame:
        """``doc_id, bm25`` of the top ``limit`` chunks for a clause or a query text: boolean, phrase, prefix, field and range conditions.

        Answered from the postings; of the chunks only the columns that ranges and other fields name are read.
        """
        if isinstance(clause, str):
            clause = parse_query(clause, QUERY_FIELDS)
        post = self.store.layer("postings")
        if clause is None:
            return post.select("doc_id", F.lit(None).cast("double").alias("bm25")).where(F.lit(False))
        n, avg = self._corpus_stats(field)
        layers = (post, self.store.terms(), self.store.layer("lengths"))
        return rank_clause_postings(*layers, clause, limit, n, avg or 1.0, field=field, meta=self.chunks(), allowed=allowed)

    def _corpus_stats(self, field: str) -> tuple[int, float]:
        """Chunk count and mean length of a field, computed once per committed version."""
        key = (self.store.head.version, field)
        if self._stats.get("key") != key:
            lengths = self.store.layer("lengths").where(F.col("field") == field)
            self._stats = {"key": key, "row": tuple(lengths.agg(F.count("*"), F.avg("dl")).first())}
        return self._stats["row"]

    def search(
        self,
        query: str,
        filters: Mapping | None = None,
        k: int = 10,
        *,
        mode: str = "and",
        filter_mode: str = "post",
        budget: int | None = None,
    ) -> DataFrame:
        """``doc_id, score`` (cosine, larger is better), at most ``k`` rows of the ``budget`` best BM25 candidates.

        The budget defaults to ten candidates per result, 100 at most; one below ``k`` is an error.
        """
        found = self.bm25_candidates(query, filters, candidate_budget(k, budget), mode=mode, filter_mode=filter_mode)
        vector = embed_one(self.embedder, query)
        vectors = self.store.layer("vectors")
        if vector is None:
            return vectors.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
        return rank_allowed(vectors, found, F.array(*map(F.lit, vector)), k)

    def search_with_context(
        self, query: str, filters: Mapping | None = None, k: int = 10, *, collapse_parent: bool = False, **options
    ) -> DataFrame:
        """Enriched hits, best first: file, chunk, and the parent section of an L2; ``options`` as for :meth:`search`."""
        hits = [(r["doc_id"], r["score"]) for r in self.search(query, filters, k, **options).collect()]  # at most k
        return with_context(
            self.spark.createDataFrame(hits, "doc_id long, score double"), self.chunks(), collapse_parent=collapse_parent
        )

    def search_vectors(self, query: str, k: int = 10) -> DataFrame:
        """Unrestricted vector search: the codes are scanned, the vectors of what can be among the nearest are compared exactly."""
        vector = embed_one(self.embedder, query)
        if vector is None:
            raise ValueError("the query could not be embedded")
        close = survivors(self.store.layer("codes"), vector, k)
        return rank_allowed(self.store.layer("vectors"), close, F.array(*map(F.lit, vector)), k)

    def render(self, results: DataFrame) -> DataFrame:
        return results.select("id", "score", hit_text().alias("text"))

    # reads

    def chunks(self) -> DataFrame:
        return self.store.layer("chunks")

    def get_content(self, doc_id: int) -> dict | None:
        row = self.chunks().where(F.col("doc_id") == doc_id).first()
        return row.asDict() if row else None

    def keys(self) -> DataFrame:
        return self.chunks().select("doc_id")

    def __contains__(self, doc_id: int) -> bool:
        return self.get_content(doc_id) is not None

    def __getitem__(self, doc_id: int) -> dict:
        row = self.get_content(doc_id)
        if row is None:
            raise KeyError(doc_id)
        return row

    def __len__(self) -> int:
        return self.chunks().count()

    def __bool__(self) -> bool:
        return True

    def get_by_filepath(self, path: str) -> DataFrame:
        return docstore.by_filepath(self.chunks(), path)

    def get_parent_chunk(self, doc_id: int) -> dict | None:
        ids = self.spark.createDataFrame([(doc_id,)], REMOVED)
        row = parent_chunks(ids, self.chunks()).first()
        if row is None or row["parent_doc_id"] is None:
            return None
        return self.get_content(row["parent_doc_id"])

    def chunk_mapping(self) -> DataFrame:
        return docstore.chunk_mapping(self.chunks())

    def consistency(self) -> DataFrame:
        layers = self.store.layer
        return docstore.consistency(layers("chunks"), layers("lengths").where("field = 'content'"), layers("vectors"))

    def verify_consistency(self) -> bool:
        return self.consistency().first()["consistent"]

    def stats(self) -> dict:
        layers = self.store.layer
        return {
            "bm25_chunks": layers("lengths").where("field = 'content'").count(),
            "vec_vectors": layers("vectors").count(),
            "store_docs": layers("chunks").count(),
            "compression_ratio": layers("codes").agg(stored_ratio()).first()[0],
            "id_counter": self.store.head.max_id,
        }

    # registry

    def registry(self) -> DataFrame:
        return self.store.registry()

    def registry_stats(self) -> dict:
        return reg.stats(self.registry()).first().asDict()

    def list_files(self, status: str | None = None) -> DataFrame:
        return reg.listing(self.registry(), status)

    def pending_files(self) -> DataFrame:
        return reg.pending(self.registry())

    def errors(self) -> DataFrame:
        return reg.errors(self.registry())

    def clear(self) -> None:
        """Forget all chunks and files."""
        self.store.clear()

    def removed_count(self) -> int:
        """Hidden chunks that :meth:`compact` would drop."""
        return self.store.removed().distinct().count()

    def compact(self, keep_versions: int = 1) -> int:
        """Drop hidden rows; folders of all but the last ``keep_versions`` floors are deleted."""
        return self.store.compact(keep_versions)

    # conversion

    def convert(
        self,
        paths: Sequence[str],
        out_dir: str | None = None,
        *,
        rewriter: Rewriter | None = None,
        extensions: Sequence[str] = (),
        ignore: Sequence[str] = (),
    ) -> DataFrame:
        """Convert office files; with ``out_dir`` also write the Markdown tree there.

        A ``rewriter`` turns on the model repair of low-quality conversions.
        """
        # stored, so that the tree and the returned rows come from one parse of the files
        files = materialize(read_files(self.spark, paths, extensions, ignore), "files")
        converted = materialize(with_quality(convert(files, pdf_reader=self.pdf_reader)), "converted")
        if out_dir:
            write_tree(tree(converted), out_dir)
        return repair(converted, rewriter) if rewriter else converted

    def extract_images(self, paths: Sequence[str], out_dir: str) -> None:
        """Write the images of Word files to ``out_dir/<document>/img_<n>.<ext>``."""
        write_images(read_docx(read_files(self.spark, paths, [".docx"]), "file_path"), out_dir)

"""Logical tables (brand, family, release, spec, source, review, run ...) over the given parquet.

One place maps the supplied star schema to the schema the operators expect. A production
deployment replaces this module by readers of its own tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfsight.functions import lexicons as lx

REVIEW_AS_OF = "2001-12-01 00:00:00"
RUN_AS_OF = "2024-01-31 12:00:00"


def as_of(value: str = REVIEW_AS_OF) -> Column:
    return F.lit(value).cast("timestamp")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def release(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("release_id"),
            F.col("p_brand").alias("brand"),
            F.col("p_name").alias("family"),
            F.concat_ws(":", "p_brand", "p_name").alias("family_id"),
            F.concat(F.col("p_name"), F.lit(" v"), k.cast("string")).alias("version_name"),
            F.when(k % 50 != 0, (2015 + k % 11).cast("int")).alias("release_year"),
            F.when(k % 40 != 0, F.col("p_retailprice").cast("decimal(8,2)")).alias("msrp_usd"),
            (k % 3 != 0).alias("is_current"),
            (k % 4 == 0).alias("is_plated"),
            F.when(k % 17 != 0, F.col("p_type")).alias("foam"),
            F.when(k % 6 != 0, F.concat(F.lit("Daily "), F.lower("p_type"), F.lit(" use"))).alias("usage_summary"),
        )

    def family(self) -> DataFrame:
        first = F.col("first_key")
        return (
            self.table("part")
            .groupBy("p_brand", "p_name")
            .agg(F.min("p_type").alias("first_type"), F.min("p_partkey").alias("first_key"))
            .select(
                F.concat_ws(":", "p_brand", "p_name").alias("family_id"),
                F.concat(F.lower("first_type"), F.lit("-trainer")).alias("category"),
                F.when(first % 4 == 0, "road").when(first % 4 == 1, "trail")
                .when(first % 4 == 2, "track").otherwise("mixed").alias("terrain"),
                F.when(first % 3 == 0, "stability").otherwise("neutral").alias("stability"),
            )
        )

    def spec(self) -> DataFrame:
        k = F.col("p_partkey")
        heel = F.when(k % 11 != 0, (20 + F.col("p_size") % 25).cast("int"))
        drop = F.when(k % 11 != 0, (k % 13).cast("int"))
        return self.table("part").select(
            k.alias("release_id"),
            F.when(k % 13 != 0, ((60 + k % 60) / 10).cast("decimal(4,1)")).alias("weight_oz"),
            heel.alias("heel_mm"),
            (heel - drop).alias("forefoot_mm"),
            drop.alias("drop_mm"),
            F.when(k % 5 == 0, F.concat(F.lit("Fit note "), k.cast("string"))).alias("fit_notes"),
            F.when(k % 7 == 0, F.concat(F.lit("Source note "), k.cast("string"))).alias("source_notes"),
        )

    def variant(self) -> DataFrame:
        spec = self.spec()
        keys = F.array(
            F.struct(F.lit("default").alias("key"), F.lit("Default").alias("label"),
                     F.lit("unknown").alias("audience"), F.lit(0.0).alias("lighter")),
            F.struct(F.lit("mens").alias("key"), F.lit("Men").alias("label"),
                     F.lit("mens").alias("audience"), F.lit(0.0).alias("lighter")),
            F.struct(F.lit("womens").alias("key"), F.lit("Women").alias("label"),
                     F.lit("womens").alias("audience"), F.lit(1.5).alias("lighter")),
        )
        k = F.col("release_id")
        return (
            spec.select("*", F.explode(keys).alias("v"))
            .filter((F.col("v.key") == "default") | ((F.col("v.key") == "mens") & (k % 2 == 0))
                    | ((F.col("v.key") == "womens") & (k % 4 < 2)))
            .select(
                "release_id",
                F.col("v.key").alias("variant_key"),
                F.col("v.label").alias("display_label"),
                F.col("v.audience").alias("audience"),
                (F.col("v.key") == "default").alias("is_primary"),
                (F.col("weight_oz") - F.col("v.lighter").cast("decimal(4,1)")).cast("decimal(4,1)").alias("weight_oz"),
                "heel_mm", "forefoot_mm", "drop_mm", "fit_notes", "source_notes",
            )
        )

    def source(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            s.alias("source_id"),
            F.col("s_name").alias("source_name"),
            F.when(s % 3 == 0, "editorial").when(s % 3 == 1, "reddit").otherwise("user").alias("source_type"),
        )

    def author(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("author_id"),
            F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit(" supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
            .otherwise(F.col("c_name")).alias("display_name"),
        )

    def review(self, with_author: bool = False, with_text: bool = False) -> DataFrame:
        quantity = F.floor("l_quantity").cast("int")
        hits = [F.when(quantity % (i + 2) == 0, F.lit(label)) for i, (label, _) in enumerate(lx.HIGHLIGHT_PATTERNS)]
        line, order = F.col("l_linenumber"), F.col("l_orderkey")
        flags = F.concat("l_returnflag", "l_linestatus")
        columns = [
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
            F.col("l_partkey").alias("release_id"),
            F.col("l_suppkey").alias("source_id"),
            F.when(F.col("l_discount") != 0.05, F.floor(F.col("l_quantity") * 2).cast("int")).alias("score"),
            F.when(F.col("l_tax") == 0, F.lit(None))
            .when(F.col("l_discount") >= 0.07, "positive")
            .when(F.col("l_discount") <= 0.02, "negative").otherwise("mixed").alias("sentiment"),
            F.when(flags == "AF", "approved").when(flags == "AO", "rejected")
            .when(F.col("l_returnflag") == "N", "pending").otherwise("flagged").alias("status"),
            F.when(line != 7, F.col("l_shipdate").cast("timestamp")).alias("published_at"),
            (F.lit("2002-01-01").cast("timestamp") + F.make_dt_interval(days=(order % 5).cast("int"))).alias("created_at"),
            F.slice(F.array_compact(F.array(*hits)), 1, 3).alias("highlights"),
            F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/r/"),
                     order.cast("string"), F.lit("-"), line.cast("string")).alias("source_url"),
            F.when(order % 4 != 0, F.concat(F.lit("importer-"), (order % 5).cast("string"))).alias("importer"),
            (order * 7 + line).alias("doc_slot"),
        ]
        items = self.table("lineitem")
        if with_author:
            orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("author_id"))
            items = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            columns.append(F.col("author_id"))
        rows = items.select(*columns)
        return self.attach_text(rows) if with_text else rows

    def document(self, spread: bool = False) -> DataFrame:
        """Documents; with spread, dealt out by number before work that is far larger than reading: few row groups are few tasks otherwise."""
        title = F.regexp_extract("text", "^([^\n]*)", 1)
        rows = self.table("documents")
        return (self.spread(rows, "doc_id") if spread else rows).select(
            "doc_id", "lang", "source",
            title.alias("title"),
            F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("excerpt"),
            F.col("text").alias("body"),
        )

    def document_count(self) -> Column:
        return self.table("documents").agg(F.count("*")).scalar()

    def attach_text(self, rows: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        documents = self.document() if documents is None else documents
        slotted = rows.withColumn("doc_id", F.col("doc_slot") % self.document_count())
        return slotted.join(documents, "doc_id")

    def run(self) -> DataFrame:
        return self.run_rows(self.table("events"))

    def run_rows(self, events: DataFrame) -> DataFrame:
        status = F.col("event_type")
        return events.select(
            F.col("event_id").alias("run_id"),
            (F.col("user_id") % 6).alias("crawl_source_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("release_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.when(status == "error", "failed").when(status == "purchase", "partial")
            .when(status == "click", "succeeded").when(status == "view", "running").otherwise("queued").alias("status"),
            F.floor("value").cast("bigint").alias("value"),
        )

    def crawl_source(self) -> DataFrame:
        rows = [
            (0, 0, "importer-0", "hourly", True),
            (1, 1, "importer-1", " Daily ", True),
            (2, 2, "importer-2", "weekly", True),
            (3, 3, "importer-3", "manual", True),
            (4, 4, "importer-4", "twice-daily", True),
            (5, 5, "importer-5", None, False),
        ]
        schema = "crawl_source_id bigint, source_id bigint, importer_key string, cadence_label string, is_active boolean"
        return self.spark.createDataFrame(rows, schema)

    def page(self) -> DataFrame:
        return self.table("pages").select("page_id", "url", "html")

    def metadata(self) -> DataFrame:
        """Release metadata documents with the irregularities lenient readers must survive."""
        def pick(expr: str, values: list[str]) -> str:
            return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

        k, text = "p_partkey", "CAST(p_partkey AS STRING)"
        evidence = [
            """'[{"sourceName":"S'""", text, """'","sourceType":"editorial","title":"T","excerpt":" e1 "},'""",
            """'{"sourceName":"R","sourceType":"reddit","title":null,"excerpt":"e2"}'""",
            f"""if({k} % 2 = 0, ',{{"sourceName":"U","sourceType":"user","excerpt":"e3"}}', '')""",
            f"""if({k} % 3 = 0, ',{{"sourceName":"X","sourceType":"paper","excerpt":"no"}},7,{{"sourceName":"Y","sourceType":"user","excerpt":"  "}}', '')""",
            "']'",
        ]
        summary = [
            """'"aiReviewSummary":{"overview":"'""", f"if({k} % 37 = 0, '  ', concat(' Overview ', {text}, ' '))",
            """'","overallSentiment":"'""", f"if({k} % 23 = 0, 'great', {pick(k + ' % 4', ['positive', 'mixed', 'negative', 'positive'])})",
            """'","confidence":"'""", pick(f"{k} % 3", ["high", "medium", "low"]),
            """'","editorialSentiment":'""", f"""CASE {k} % 5 WHEN 1 THEN '"positive"' WHEN 2 THEN '"mixed"' ELSE 'null' END""",
            """',"communitySentiment":'""", f"""CASE {k} % 6 WHEN 1 THEN '"negative"' WHEN 2 THEN '"odd"' ELSE 'null' END""",
            """',"sourceAlignment":"'""", pick(f"{k} % 4", ["aligned", "mixed", "divergent", "unsure"]),
            """'","buyerSignal":'""", f"""if({k} % 7 = 0, '5', concat('"Signal ', {text}, '"'))""",
            """',"pros":["'""", pick(f"{k} % 3", ["Smooth ride", "Smooth foam", "Light upper"]), """'",3," ","Grip '""",
            pick(f"{k} % 5", ["wet", "dry", "trail", "road", "track"]), """' "]'""",
            """',"cons":["Price is high"],"bestFor":['""", f"""if({k} % 4 <> 0, concat('"Tempo ', {pick(k + ' % 7', list('abcdefg'))}, '"'), '')""", "']'",
            """',"watchOuts":"none","consensusPoints":["c1","c2","c3","c4","c5"],"debates":[]'""",
            """',"reviewCount":'""", f"""if({k} % 29 = 0, '"9"', CAST({k} % 9 AS STRING))""",
            """',"sourceCount":'""", f"CAST({k} % 5 AS STRING)",
            """',"generatedAt":"2001-11-0'""", f"CAST(1 + {k} % 9 AS STRING)",
            """'T10:00:00.000Z","model":null,"provider":"heuristic","evidence":'""", *evidence, "'}'",
        ]
        override = [
            """',"editorialAiReviewSummaryOverride":{"isEnabled":'""", f"if({k} % 8 = 0, 'true', 'false')",
            """',"overview":'""", f"""if({k} % 16 = 0, '"Edited overview"', 'null')""",
            """',"overallSentiment":"negative","pros":["Edited pro"],"cons":[],"updatedAt":"2001-11-20T00:00:00.000Z"}'""",
        ]
        editorial = [
            """',"editorialReviewSummary":{"summaryNote":"Note '""", text, """'","pinnedTakeaways":['""",
            f"""if({k} % 10 = 0, '"Pinned take"', '')""", """'],"ignoredThemes":["'""", pick(f"{k} % 3", ["Fit", "Ride", "Value"]), """'"]}'""",
        ]
        document = (f"concat('{{', {', '.join(summary)}, if({k} % 4 = 0, concat({', '.join(override)}), ''), "
                    f"if({k} % 9 = 0, concat({', '.join(editorial)}), ''), '}}')")
        rule = f"CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 13 = 0 THEN '{{broken' WHEN {k} % 19 = 0 THEN '[1]' ELSE {document} END"
        return self.spread(self.table("part").select(k)).selectExpr(f"{k} AS release_id", f"{rule} AS metadata")

    def spread(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows dealt out before work that is far larger than their file: the few megabytes of a table's keys are a single task otherwise."""
        return rows.repartition(min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism), *keys)

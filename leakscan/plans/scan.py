"""The scan: files to scored candidates to findings.

One row per file stays one row until its lines with candidate values go out, so the corpus is never
shuffled; what is shuffled are candidate lines (for dictionary signals) and their rule matches. Both are
written to the shared folder, so the files are read once however many branches the plan has. Every row gets
a number with the first of these tables: rows that share a uri, or are equal, keep their own matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions.text import blank, finding_id, let, suppression_key
from leakscan.operators import gates as G
from leakscan.operators import identifiers as I
from leakscan.operators import layers as Y
from leakscan.operators import lines as L
from leakscan.operators import literals as S
from leakscan.operators import paths, suppress
from leakscan.operators import rules as R
from leakscan.plans import config as K
from leakscan.sources.state import written


#: What a scan reads of a file's row.
INPUTS = ("file_uri", "content", "language_id", "changed_lines")


def unpacked(rows: DataFrame) -> DataFrame:
    """`rows` with the columns that `extra` packs, but for those named like one of their own (any case)."""
    own = [c for c in rows.columns if c != "extra"]
    taken, kind = {c.lower() for c in own}, rows.schema["extra"].dataType
    more = [c for c in getattr(kind, "names", []) if c.lower() not in taken]
    return rows.select(*own, *[F.col("extra").getField(c).alias(c) for c in more])


def _beside(surrounding: Column) -> Column:
    return F.concat_ws("\n", L.adjacent(surrounding))


@dataclass
class Scanner:
    """What a scan needs besides files."""

    ruleset: R.RuleSet
    dictionary: DataFrame
    config: dict
    broadcast_dictionary: bool = True
    #: The dictionary's keywords as `I.plain_keywords`; without them every name is looked up.
    plain: list[str] | None = None

    @classmethod
    def default(cls, spark: SparkSession, rules: str | dict | None = None, dictionary: DataFrame | None = None, config: dict | None = None) -> Scanner:
        """Built-in rules and seed dictionary where none are given. The dictionary is counted before it is broadcast, or read if it is short."""
        config = config or K.load()
        data = rules if isinstance(rules, dict) else R.load(rules)
        if config["options"]["useCustomRules"]:
            data = {**data, "rules": [*data["rules"], *config["customRules"]]}
        own = I.seed(spark) if dictionary is None else dictionary.groupBy("keyword").agg(F.min("group").alias("group"))
        own = own.select("keyword", "group")
        few = own.limit(I.FEW_ROWS + 1).collect()
        if len(few) > I.FEW_ROWS:
            return cls(R.compile_rules(spark, data), own, config, own.count() <= I.BROADCAST_ROWS)
        return cls(R.compile_rules(spark, data), spark.createDataFrame(few, own.schema), config, True, I.plain_keywords([r["keyword"] for r in few]))

    # --- stages ---

    def read(self, files: DataFrame, counted: bool = True) -> DataFrame:
        """The one pass over `files` (file_uri, content, optional language_id, changed_lines), written once: a row per row with row_id,
        risk, n_lines (0 for excluded files) and lines, those that hold a candidate value and a keyword, may hold a dictionary name or
        have a keyword beside them, with their neighbours. Further columns are packed as `extra`, where none clashes with the scan's.
        Without `counted` only the lines tell n_lines."""
        i = self.config["ignore"]
        extra = [c for c in files.columns if c not in INPUTS]
        packed = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in extra]) if extra else F.lit(None).cast("int")
        out = files.select(*[c for c in files.columns if c in INPUTS], packed.alias("extra"))
        out = out.withColumn("risk", paths.risk(F.col("file_uri"), tuple(i["paths"]), i["useDefaultIgnorePaths"])).withColumn("row_id", F.monotonically_increasing_id())
        excluded = F.coalesce(F.col("risk") == "EXCLUDED", F.lit(False))
        content = F.coalesce("content", F.lit(""))
        off = F.substring_index(content, "\n", 1).contains("leakscan-disable-file") if self.config["options"]["skipFilesMarkedDisabled"] else F.lit(False)
        marked = lambda text: let(text, lambda x: x.contains('"') | x.contains("'") | x.contains("`") | x.contains("="))
        offers = lambda line: marked(line) & line.rlike(S.OFFERS)
        keyed = lambda text: R.may_hold(text, self.ruleset.keyword_set)
        told = lambda line, near: keyed(line) | keyed(_beside(near)) | I.may_name(S.code(line), self.plain)
        has = lambda line, near: told(line, near) & (F.size(S.candidate_values(line)) > 0)
        out = L.with_lines(out.withColumns({"content": F.when(~excluded, content), "off": off}), keep=offers, keep_near=has, keep_text=marked, counted=counted)
        lines = F.when(~F.col("off"), F.col("lines"))
        return written(out.withColumns({"lines": lines} | ({"n_lines": F.coalesce("n_lines", F.lit(0))} if counted else {})).drop("off"))

    def lines(self, read: DataFrame) -> DataFrame:
        """The lines of `read` that may hold a secret, with their keyword hits, names and candidate values, written once."""
        keywords = self.ruleset.keyword_set
        out = read.where(F.size("lines") > 0).select(*[c for c in read.columns if c != "lines"], F.inline("lines")).where(~blank(F.col("line")))
        out = out.withColumn("db1_hits", R.keyword_hits(F.col("line"), keywords)).withColumn("adjacent", L.adjacent(F.col("surrounding")))
        near = F.lower(_beside(F.col("surrounding"))).rlike(R.keyword_pattern(keywords))
        out = out.withColumn("adjacent_hit", near).withColumn("line_id", F.concat_ws(":", "row_id", "line_no"))
        names = Y.names(F.col("line"), F.col("line_no"), F.col("surrounding"), self.plain)
        return written(out.withColumns({"names": names, "values": S.candidate_values(F.col("line"))}))

    def candidates(self, files: DataFrame) -> DataFrame:
        """Candidate values of lines with a keyword, a dictionary name or a keyword beside them. The files' further columns come along,
        but for those named like a column of the scan."""
        return unpacked(self._candidates(self.read(files, counted=False)))

    def _candidates(self, read: DataFrame) -> DataFrame:
        lines = self.lines(read)
        known = Y.signals(lines.select("line_id", "names"), self.dictionary, self.broadcast_dictionary)
        out = lines.drop("names").join(known, "line_id", "left").withColumn("signals", F.coalesce("signals", Y.no_signals())).withColumn("db2_hits", F.coalesce("db2_hits", F.array().cast("array<string>")))
        out = out.where((F.size("db1_hits") > 0) | (F.size("db2_hits") > 0) | F.col("adjacent_hit"))
        out = out.withColumn("c", F.explode("values")).select("*", "c.*").drop("c", "values")
        return out.withColumn("cand_id", F.concat_ws(":", "line_id", "start_pos", "quote"))

    def scored(self, files: DataFrame) -> DataFrame:
        """Candidates with all layers, reductions, score, its explanation, severity, suppression key and id. The files' further columns
        come along, but for those named like a column of the scan."""
        return unpacked(self._scored(self.read(files, counted=False)))

    def _scored(self, read: DataFrame, found: bool = False) -> DataFrame:
        """`scored`, packed. With `found`, candidates whose layers are too low for a severity go before the rules' allowlists and the reductions,
        which no score rises by."""
        cfg, value, line = self.config, F.col("value"), F.col("line")
        least = cfg["detection"]["minimumConfidenceToWarn"]
        c = written(self._candidates(read))
        best = R.match_rules(c.select("cand_id", "value", "line", "db1_hits", F.col("file_uri").alias("path")), self.ruleset, cfg["options"]["useRulePaths"])
        c = c.join(best, "cand_id", "left")
        c = c.withColumns({"matched": F.col("rule_id").isNotNull(), "known_provider": F.coalesce("known_provider", F.lit(False)), "generic": F.coalesce("generic", F.lit(False)), "l1_score": F.coalesce("l1_score", F.lit(0.0))})
        c = c.withColumns(Y.entropy_layer(value, F.col("rule_entropy")))
        c = c.withColumns({"l3_score": Y.context_score(F.col("signals")), "matched_groups": Y.matched_groups(F.col("signals")), "l4_score": Y.string_score(value, line, F.col("surrounding"))})
        c = c.withColumns(Y.file_score(line, F.col("in_comment"), F.col("risk")))
        specific = F.exists("signals", lambda s: (s["distance"] == 0) & s["group"].isin(Y.fixed.SPECIFIC_GROUPS))
        layers = {k: F.col(k) for k in ("l1_score", "l2_score", "l2_entropy", "l3_score", "l4_score", "l5_score", "matched", "known_provider", "generic", "file_factor", "value")} | {"specific_context": specific}
        c = written(c.where(G.may_reach(layers, K.weights(cfg), least)) if found else c)  # the rules are matched once for what follows
        path = F.replace("file_uri", F.lit("\\"), F.lit("/"))
        allow = R.allowlisted(c.where("rule_id is not null").select("cand_id", "rule_id", "value", "line", path.alias("path")), self.ruleset) if self.ruleset.allowlists else None
        c = c.join(allow, "cand_id", "left") if allow is not None else c.withColumn("rule_reason", F.lit(None).cast("string"))
        c = c.withColumns(G.placeholder(value, line, F.col("adjacent"))).withColumns(G.non_secret_format(value))
        c = c.withColumn("allow_reason", G.allow_reason(value, line, F.col("rule_reason"), K.stopwords(cfg), K.patterns(cfg), K.marks(cfg)))
        c = written(c)  # the scores are used several times from here on
        cols = layers | {k: F.col(k) for k in ("placeholder_factor", "format_factor")} | {"allowed": F.col("allow_reason").isNotNull()}
        c = c.withColumns(G.confidence(cols, K.weights(cfg)))
        c = c.withColumn("explanation", G.explanation({k: F.col(k) for k in c.columns} | {"allowed": F.col("allow_reason").isNotNull()}))
        return c.withColumns({"severity": F.when(G.passes(F.col("score"), least), G.severity(F.col("score"))), "suppression_key": suppression_key(F.col("file_uri"), F.col("line_no"), line, F.col("rule_id")), "finding_id": finding_id(F.col("file_uri"), F.col("line_no"), F.col("start_pos"), value)})

    def findings(self, files: DataFrame, suppressions: DataFrame | None = None, now=None) -> DataFrame:
        """Scored candidates with a severity that no suppression in force covers."""
        out = unpacked(self._scored(self.read(files, counted=False), found=True)).where("severity is not null")
        return out if suppressions is None else suppress.apply(out, suppressions, now)

    def funnel(self, files: DataFrame) -> DataFrame:
        """One row per row of `files`: lines, candidates, findings and what each gate took; excluded files have zeros."""
        read = self.read(files)
        counts = self._scored(read).groupBy("row_id").agg(
            F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("severity").isNotNull()).alias("findings"),
            F.count_if(F.col("allow_reason").isNotNull() & ~F.col("known_provider")).alias("skipped_gate5"), F.count_if(F.col("severity").isNull()).alias("skipped_gate7"),
        )
        base = read.select("row_id", "file_uri", F.coalesce(F.col("risk") == "EXCLUDED", F.lit(False)).cast("long").alias("skipped_gate0"), F.col("n_lines").cast("long").alias("lines_scanned"))
        out = base.join(counts, "row_id", "left")
        return out.select("file_uri", "lines_scanned", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "findings")], "skipped_gate0", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("skipped_gate5", "skipped_gate7")])

"""Row enrichment: label lookups, topic rules, detail merges, what to update next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Topics and the words that tell them.
TOPIC_RULES = {
    "Agriculture and food": r"\b(?:agricultur|crop|food|farm|livestock|soil)\w*",
    "Artificial intelligence and machine learning": r"\b(?:artificial intelligence|machine learning|deep learning|generative ai|AI/ML)\b",
    "Arts and culture": r"\b(?:arts?|cultur|museum|music|theater|humanities)\w*",
    "Biology and biotechnology": r"\b(?:biolog|biotechnolog|genom|proteom|cellular|microbiom)\w*",
    "Cancer": r"\b(?:cancer|oncolog|tumou?r|carcinom|neoplasm)\w*",
    "Carbon management": r"\b(?:carbon capture|carbon utilization|carbon storage|carbon management|direct air capture|CO2)\b",
    "Catalysis and reaction engineering": (
        r"\b(?:catalys(?:is|es)|catalytic (?:reaction|process|conversion|activity|material|system|site|mechanism|chemistry|engineering|technology|performance)"
        r"|(?:electro|photo|thermo)catalys\w*|reaction engineering|reactor design)\b"
    ),
    "Climate change": r"\b(?:climate change|decarboni[sz]|greenhouse gas|global warming|climate resilience)\w*",
    "Community development": r"\b(?:community development|community engagement|rural development|economic development)\b",
    "Cybersecurity": r"\b(?:cybersecurity|cyber security|information security)\b",
    "Data science": r"\b(?:data science|data analytics|big data|informatics)\b",
    "Education and workforce": r"\b(?:education|student|teacher|curriculum|workforce|training)\w*",
    "Energy": r"\b(?:energy|battery|fuel cell|hydrogen|solar|wind power|nuclear power|grid)\w*",
    "Environmental science": r"\b(?:environment|ecosystem|ecolog|pollution|conservation|biodiversity)\w*",
    "Health equity": r"\b(?:health disparit|health equit|underserved population|social determinants of health)\w*",
    "Infectious disease": r"\b(?:infectious disease|virus|viral|bacteri|pathogen|pandemic)\w*",
    "Manufacturing": r"\b(?:manufactur|industrial process|supply chain|semiconductor)\w*",
    "Materials science": r"\b(?:materials? science|advanced materials?|polymer|nanomaterial|metallurg|ceramic)\w*",
    "Neuroscience": r"\b(?:neuroscien|neurolog|brain|cognitive|neurodegener)\w*",
    "Public health": r"\b(?:public health|population health|epidemiolog|health services)\w*",
    "Quantum science": r"\b(?:quantum|qubit|quantum computing)\w*",
    "Separations and membranes": r"\b(?:separation science|membrane|adsorption|chromatograph|purification)\w*",
    "Social and behavioral sciences": r"\b(?:social science|behavioral|psycholog|sociolog|human behavior)\w*",
    "Space and aeronautics": r"\b(?:spacecraft|aeronautic|aerospace|NASA|space science)\w*",
    "Technology development": r"\b(?:technology development|prototype|commerciali[sz]|innovation)\w*",
    "Transportation": r"\b(?:transportation|transit|rail|aviation|vehicle|maritime)\w*",
    "Water": r"\b(?:water treatment|wastewater|drinking water|water quality|desalination|hydrolog)\w*",
}


def labels_for(codes: Column, labels: Mapping[str, str]) -> Column:
    """Codes as labels; a code without a label stays."""
    if not labels:
        return codes
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(names, c), c))


def topics(text: Column, rules: Mapping[str, str]) -> Column:
    """Names of all rules whose pattern the text has, in the order of the rules."""
    return F.filter(F.array(*[F.when(text.rlike(f"(?iU){p}"), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())


def union_topics(own: Column, found: Column) -> Column:
    """Own values first, found ones that are new behind them."""
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), found))


def search_terms(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """Terms added for each phrase that the text contains."""
    added = [F.when(F.contains(F.lower(text), F.lit(p.lower())), F.array(*map(F.lit, t))).otherwise(F.array().cast("array<string>")) for p, t in rules.items()]
    return F.array_distinct(F.concat(*added))


def differs(a: Column, b: Column) -> Column:
    """Whether both are present and not equal; '' counts as absent."""
    x, y = F.nullif(a.cast("string"), F.lit("")), F.nullif(b.cast("string"), F.lit(""))
    return F.coalesce(x != y, F.lit(False))


def merge_detail(records: DataFrame, detail: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Records with gaps filled from ``detail``; ``conflicts`` lists fields where both have a value and differ."""
    extra = detail.select(F.col(key), *[F.col(f).alias(f"_d_{f}") for f in fields])
    met = records.join(extra, key, "left")
    clash = F.filter(F.array(*[F.when(differs(F.col(f), F.col(f"_d_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    met = met.withColumn("conflicts", clash)
    return met.select(*[F.coalesce(c, f"_d_{c}").alias(c) if c in fields else F.col(c) for c in records.columns], "conflicts")


def signature(*fields: Column) -> Column:
    """Digest of the fields whose change makes a record due."""
    return F.sha2(F.to_json(F.struct(*[f.cast("string").alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}), 256)


def due_for_update(records: DataFrame, cache: DataFrame, key: str, signature: Column, today: Column, recheck_days: int, limit: int) -> DataFrame:
    """Records to fetch: never fetched, changed, failed a day ago or checked too long ago; the oldest first.

    ``cache`` has the key, signature, checked_on and ok.
    """
    old = cache.select(F.col(key), F.col("signature").alias("_sig"), F.col("checked_on").alias("_on"), F.col("ok").alias("_ok"))
    met = records.withColumn("signature", signature).join(old, key, "left")
    age = F.datediff(today, F.col("_on"))
    wait = F.when(F.col("_ok"), F.lit(recheck_days)).otherwise(F.lit(1))
    reason = F.when(F.col("_sig").isNull(), "missing").when(F.col("_sig") != F.col("signature"), "changed").when(F.col("_on").isNull() | (age >= wait), "recheck")
    due = met.withColumn("due", reason).where("due is not null")
    order = F.when(F.col("due") == "missing", 0).when(F.col("due") == "changed", 1).otherwise(2)
    return due.orderBy(order, F.col("_on").asc_nulls_first(), key).limit(limit).drop("_sig", "_on", "_ok")


def prune_cache(cache: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Cache rows of records that still exist."""
    return cache.join(records.select(key).distinct(), key, "left_semi")


def next_version(entries: DataFrame, fetched: DataFrame, key: str, keep: int = 6) -> DataFrame:
    """Versioned entries (key, version, digest, history) after a fetch (key, digest, fetched_on).

    An equal digest keeps the version; another one raises it and puts the old
    one into the history, of which the last ``keep`` stay.
    """
    new = fetched.select(F.col(key), F.col("digest").alias("_digest"), F.col("fetched_on").alias("_on"))
    met = entries.join(new, key, "full_outer")
    changed = F.col("_digest").isNotNull() & F.col("digest").isNotNull() & (F.col("_digest") != F.col("digest"))
    past = F.coalesce("history", F.array().cast("array<struct<version:int,digest:string>>"))
    grown = F.concat(past, F.array(F.struct(F.col("version").cast("int").alias("version"), "digest")))
    cut = F.slice(grown, F.greatest(F.lit(1), F.size(grown) - keep + 1), keep)
    return met.select(
        key,
        F.when(changed, F.col("version") + 1).otherwise(F.coalesce("version", F.lit(1))).cast("int").alias("version"),
        F.coalesce("_digest", "digest").alias("digest"),
        F.when(changed, cut).otherwise(past).alias("history"),
        F.when(F.col("digest").isNull(), "new").when(changed, "revised").when(F.col("_digest").isNull(), "kept").otherwise("same").alias("outcome"),
    )


def pick_document(attachments: Column) -> Column:
    """The best of array<struct<name, mime, folder>>: a notice before others, PDF before others, no amendment, then by name."""

    def score(a: Column) -> Column:
        name = F.lower(F.coalesce(a["name"], F.lit("")))
        return F.struct(
            (~name.rlike(r"nofo|notice of funding|funding opportunity|announcement|solicitation")).alias("other"),
            (~(name.endswith(".pdf") | F.coalesce(F.contains(F.lower(a["mime"]), F.lit("pdf")), F.lit(False)))).alias("not_pdf"),
            name.rlike("amend|supplement|summary of changes").alias("amended"),
            name.alias("name"),
            a.alias("attachment"),
        )

    return F.try_element_at(F.array_sort(F.transform(attachments, score)), F.lit(1))["attachment"]

"""gatelens: Spark-native analytics for LLM gateway traffic.

Operators are plain functions from DataFrames (plus config values) to
DataFrames, grouped by family in ``gatelens.operators``:

* ``prompts``, ``providers`` — conversation reshaping, provider payload layouts, chunk assembly
* ``detection`` — injection rule scan, tier-2 scoring, cascade, judge-reply parsing, categories
* ``contracts`` — behaviour contracts compiled to Columns, tiered verdicts, reports, lint
* ``drift`` — compliance series, windows, alerts, timelines, retention
* ``ordered``, ``ratelimit`` — sorted-partition folds, sliding-window admission replay
* ``vectors`` — exact thresholded cosine search, response-reuse replay
* ``routing``, ``metrics`` — alias resolution and policies, latency EMA, traffic metrics
* ``evaluation``, ``datasets`` — classifier reports, sampling, splits, training

``gatelens.streaming`` holds Structured Streaming variants; ``gatelens.plans``
registers the queries used by ``__spark_entry__``.
"""

__version__ = "0.1.0"

"""tidemark: campaign and user-lifecycle metric tables on Spark.

Every metric is a plain function from DataFrames to a DataFrame and runs no job.
Jobs are run by the sinks in ``tidemark.sources``, by what stores a table on its
way (``tidemark.plans.marts``, the hand-offs and the export), and by most of
``tidemark.llm`` while a query is built.
"""

__version__ = "0.1.0"

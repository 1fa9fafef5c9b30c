"""retentio — student-attrition analytics expressed as Spark DataFrame operators.

Sub-packages:

* ``functions`` — Column expressions (binning, feature formulas, link parsing).
* ``sources``   — table readers/writers, the history stores and the test-data views.
* ``operators`` — DataFrame -> DataFrame operators (risk, history, evaluation, features, split, kNN).
* ``ml``        — ``pyspark.ml`` Estimators/Transformers, the model registry, training and tuning.
* ``plans``     — report bundles and the registered queries with their SQL oracles.
* ``streaming`` — the stateless scoring path applied to a streaming DataFrame.
"""

from retentio.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

"""The settings leave long projections to compiled methods, and results as they are."""

from emberline.plans import pixels
from emberline.session import SETTINGS, configured


def test_settings_unfuse_only_methods_the_jvm_would_not_compile(spark, data):
    def run():
        df = pixels.k4_k5_patch_scores(spark, data)
        rows = sorted(map(tuple, df.collect()))
        return rows, df._jdf.queryExecution().executedPlan().toString()

    before = {k: spark.conf.get(k) for k in SETTINGS}
    fused, _ = run()
    code = spark._jvm.PythonSQLUtils.explainString(pixels.k4_k5_patch_scores(spark, data)._jdf.queryExecution(), "codegen")
    longest = max(int(x.split(";")[0]) for x in code.split("maxMethodCodeSize:")[1:])
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        unfused, _ = run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert fused == unfused and len(fused) and longest > int(SETTINGS["spark.sql.codegen.hugeMethodLimit"])


def test_configured_sets_each_setting():
    class Builder:
        def __init__(self):
            self.seen = {}

        def config(self, name, value):
            self.seen[name] = value
            return self

    assert configured(Builder()).seen == SETTINGS

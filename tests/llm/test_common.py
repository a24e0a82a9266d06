from umbral.llm.common import durable


def test_durable_gives_back_what_fills_the_driver(spark):
    jvm = spark.sparkContext._jvm
    runtime, held = jvm.java.lang.Runtime.getRuntime(), []
    while runtime.totalMemory() <= runtime.maxMemory() // 2:
        held.append(jvm.java.nio.ByteBuffer.allocate(1 << 26))
    held.clear()
    assert durable(spark.range(3)).count() == 3
    assert runtime.totalMemory() < runtime.maxMemory() // 4


def test_durable_keeps_what_is_in_use(spark):
    held = [spark.sparkContext._jvm.java.nio.ByteBuffer.allocate(1 << 26) for _ in range(30)]
    first = durable(spark.range(5).selectExpr("id * 2 AS x"))
    second = durable(first.where("x > 2"))
    assert sorted(r[0] for r in second.collect()) == [4, 6, 8]
    assert first.count() == 5 and held[0].capacity() == 1 << 26

import csv
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

from clientela import constants as K
from clientela.operators.durable import ensure_checkpoint_dir
from clientela.params import Period
from clientela.plans import overview
from clientela.sources.coercion import coerce_numeric
from clientela.sources import sinks
from clientela.sources.sinks import campaign_file_name, clean_outbox, read_outbox, segment_file_name, write_csv, write_outbox
from clientela.sources.tables import SCHEMAS, catalog_ledger, open_ledger, parquet_ledger


def warehouse(spark):
    """The four tables under their warehouse names, one sale each."""
    when = datetime(2024, 2, 1, 12)
    rows = {
        "customers": ("007", "Zé Lima", "z@x", "62", "999", date(1990, 1, 1), "Goiânia", "GO"),
        "sales": ("007", "a", "1", "Norte", "ERP", when, "Faturado", Decimal("10.00"), None),
        "items": ("a", "Saia", Decimal("10.00"), 2, when),
        "payments": ("a", "Pix", Decimal("10.00"), "ok", when),
    }
    for table, row in rows.items():
        df = spark.createDataFrame([row], SCHEMAS[table])
        for source, name in K.WAREHOUSE_COLUMNS[table].items():
            df = df.withColumnRenamed(name, source)
        yield K.WAREHOUSE_TABLES[table], df


YEAR = Period(date(2024, 1, 1), date(2024, 12, 31))


def first_figures(ledger):
    assert overview.overview_kpis(ledger, YEAR).first()[:3] == (1, 1, Decimal("10.00"))
    assert overview.top_categories(ledger, YEAR).first()["category"] == "Saia"
    assert overview.payment_mix(ledger, YEAR).first()["method"] == "Pix"


def test_parquet_ledger(spark, tmp_path):
    for name, df in warehouse(spark):
        df.write.parquet(f"{tmp_path}/{name}")
    first_figures(parquet_ledger(spark, str(tmp_path)))


def test_catalog_ledger(spark, tmp_path):
    for name, df in warehouse(spark):
        df.createOrReplaceTempView(name)
    first_figures(open_ledger(spark.table))
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        catalog_ledger(spark, "nowhere")


def test_coercion_is_all_or_nothing(spark):
    rows = [("1", "1", "1.5", "", "a", "007", None, "inf"), (" 2 ", None, "1e3", "3", "4", "8", None, "1")]
    names = ["whole", "gap", "decimal", "blank", "mixed", "zeros", "void", "infinite"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    coerced = coerce_numeric(df)
    assert dict(coerced.dtypes) == {
        "whole": "bigint",
        "gap": "double",
        "decimal": "double",
        "blank": "double",
        "mixed": "string",
        "zeros": "bigint",
        "void": "double",
        "infinite": "double",
    }
    got = coerced.collect()
    assert [r["whole"] for r in got] == [1, 2]
    assert [r["blank"] for r in got] == [None, 3.0]
    assert [r["zeros"] for r in got] == [7, 8]
    assert dict(coerce_numeric(df, ["whole"]).dtypes)["decimal"] == "string"
    assert coerce_numeric(spark.range(1)).dtypes == [("id", "bigint")]


def test_csv_reads_back(spark, tmp_path):
    rows = [('Ana "Gê", Lima', "", None, Decimal("1.50"), date(2024, 1, 2)), (" pad ", "x\\y", "é", None, None)]
    schema = "name string, blank string, missing string, total decimal(10,2), day date"
    path = str(tmp_path / "list")
    write_csv(spark.createDataFrame(rows, schema).coalesce(1), path)
    (part,) = Path(path).glob("part-*.csv")
    text = part.read_text(encoding="utf-8")
    assert text.splitlines()[0] == "name,blank,missing,total,day"
    with part.open(encoding="utf-8", newline="") as f:
        assert list(csv.reader(f))[1:] == [
            ['Ana "Gê", Lima', "", "", "1.50", "2024-01-02"],
            [" pad ", "x\\y", "é", "", ""],
        ]


def test_outbox_rerun_replaces_its_day_only(spark, tmp_path):
    path = str(tmp_path / "outbox")

    def messages(day, *phones):
        return spark.createDataFrame([(day, p) for p in phones], "run_date date, whatsapp string")

    first, second = date(2024, 1, 1), date(2024, 1, 2)
    write_outbox(messages(first, "1", "2"), path, first)
    write_outbox(messages(second, "3"), path, second)
    write_outbox(messages(first, "4"), path, first)
    stored = spark.read.parquet(path)
    assert sorted(stored.select("run_date", "whatsapp").collect()) == [(first, "4"), (second, "3")]
    # a rerun that finds nobody leaves nobody
    write_outbox(messages(first), path, first)
    assert spark.read.parquet(path).select("whatsapp").collect() == [("3",)]


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "after_write", "commit", "after_commit", "forget_data", "forget_record"])
def test_outbox_that_fails_between_two_steps(spark, tmp_path, monkeypatch, step):
    """Either the old day is read or the new one, and the next run puts things right."""
    path, day, other = str(tmp_path / "outbox"), date(2024, 1, 1), date(2024, 1, 2)

    def messages(day, *phones):
        return spark.createDataFrame([(day, p) for p in phones], "run_date date, whatsapp string")

    def read():
        return sorted(tuple(r) for r in read_outbox(spark, path).select("run_date", "whatsapp").collect())

    write_outbox(messages(day, "old"), path, day)
    write_outbox(messages(other, "x"), path, other)
    outbox = sinks._Outbox
    commit, forget = outbox.commit, outbox.forget

    def stop(*_):
        raise Broken

    def stop_after(f):
        def run(self, *args):
            f(self, *args)
            raise Broken

        return run

    def forget_data_only(self, day, commits):
        for name in commits:
            self._files.delete(self._new(self.version(day, name.partition(".")[2])), True)
        raise Broken

    with monkeypatch.context() as patch:
        if step == "write":  # a task fails while messages are written
            bad = messages(day, "new").withColumn("whatsapp", sinks.F.raise_error(sinks.F.lit("lost")).cast("string"))
            with pytest.raises(Exception, match="lost"):
                write_outbox(bad, path, day)
        else:
            name, replacement = {
                "after_write": ("commit", stop),
                "commit": ("commit", stop),
                "after_commit": ("commit", stop_after(commit)),
                "forget_data": ("forget", forget_data_only),
                "forget_record": ("forget", stop_after(forget)),
            }[step]
            patch.setattr(outbox, name, replacement)
            with pytest.raises(Broken):
                write_outbox(messages(day, "new"), path, day)
    expected = "old" if step in ("write", "after_write", "commit") else "new"
    assert read() == [(day, expected), (other, "x")]
    write_outbox(messages(day, "newest"), path, day)
    assert read() == [(day, "newest"), (other, "x")]
    clean_outbox(spark, path)  # nothing is that old
    clean_outbox(spark, path, older_than_hours=-1)
    assert read() == [(day, "newest"), (other, "x")]
    assert spark.read.parquet(path).count() == 2


def test_outbox_without_any_day(spark, tmp_path):
    path = str(tmp_path / "outbox")
    with pytest.raises(FileNotFoundError):
        read_outbox(spark, path)
    assert read_outbox(spark, path, "run_date date, whatsapp string").count() == 0
    day = date(2024, 1, 1)
    write_outbox(spark.createDataFrame([], "run_date date, whatsapp string"), path, day)
    assert read_outbox(spark, path).dtypes == [("run_date", "date"), ("whatsapp", "string")]
    assert read_outbox(spark, path).count() == 0


def test_later_of_two_commits_counts(spark, tmp_path):
    """Two runs that know nothing of each other: the last record by name says what is read."""
    path, day = str(tmp_path / "outbox"), date(2024, 1, 1)
    outbox = sinks._Outbox(spark, path)
    for version in ("aa", "bb"):
        spark.createDataFrame([(version,)], "whatsapp string").write.parquet(outbox.version(day, version))
    outbox.commit(day, "000000000001.bb")
    outbox.commit(day, "000000000001.aa")
    assert [r.whatsapp for r in read_outbox(spark, path).collect()] == ["bb"]


def test_optional_store_of_lines(spark):
    frames = {name: df for name, df in warehouse(spark)}
    items = K.WAREHOUSE_TABLES["items"]
    frames[items] = frames[items].selectExpr("*", "'Sul' AS store")
    book = open_ledger(frames.__getitem__)
    assert "store" in book.items.columns and "store" not in book.payments.columns
    assert overview.top_categories(book, YEAR).count() == 1
    assert overview.top_categories(book, YEAR, by_store=True).count() == 0  # sold in "Norte"
    assert overview.payment_mix(book, YEAR, by_store=True).count() == 1  # no store: by id alone


def test_file_names():
    day = date(2024, 3, 5)
    name = campaign_file_name("Volta às aulas", day)
    assert name.startswith("Volta_às_aulas_") and name.endswith("_20240305")
    long = "Reativação de clientes inativos Maio "
    assert campaign_file_name(long + "A", day) != campaign_file_name(long + "B", day)
    assert "/" not in campaign_file_name("VIPs / Champions", day)
    assert segment_file_name("At Risk").startswith("rfm_at_risk_")


def test_outbox_refuses_other_days(spark, tmp_path):
    first, second = date(2024, 3, 4), date(2024, 3, 5)
    messages = spark.createDataFrame([(first, "1"), (second, "2")], "run_date date, whatsapp string")
    with pytest.raises(ValueError, match="other days"):
        write_outbox(messages, str(tmp_path / "outbox"), second)


class Session:
    """As much of a session as the choice of the checkpoint folder looks at."""

    def __init__(self, master, named=None, current=None):
        self.sparkContext = self
        self.conf = self
        self.master, self.named, self.chosen = master, named, current

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, folder):
        self.chosen = folder

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named or default


def test_checkpoint_folder():
    assert ensure_checkpoint_dir(Session("yarn", named="hdfs:///shared")) == "hdfs:///shared"
    assert ensure_checkpoint_dir(Session("yarn", current="hdfs:///set")) == "hdfs:///set"
    local = Session("local[2]")
    assert "clientela-" in ensure_checkpoint_dir(local)
    assert ensure_checkpoint_dir(local) == local.chosen
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session("spark://master:7077"))

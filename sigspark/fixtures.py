"""Signal, alignment and variant tables derived from the provided ones, for both engines.

Each view is whole: every row and every text of its source takes part. VIEWS holds Spark's SQL over a table named
{source}; SQL the same for DuckDB, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LETTERS = "'BDEFHIJKLMNOPQRSUVWXYZ','ACGTACGTACGTACGTACGTAC'"
_FOLD = "translate(upper(regexp_replace({0},'[^A-Za-z]',''{1}))," + _LETTERS + ")"

_EVENTS = """
select user_id as read_id, cast(row_number() over w - 1 as bigint) as event_idx, value as mean,
       {us} - min({us}) over (partition by user_id) as start_us,
       lead({us}) over w - {us} as dur_us,
       cast(sum(event_id % 3) over w as bigint) as ref_pos, event_id % 64 as kmer_rank, event_type as label
from {source} window w as (partition by user_id order by ts, event_id)
"""
_CALLS = """
select l_orderkey as read_id, concat(l_returnflag,l_linestatus) as chromosome, l_partkey as start_pos,
       l_partkey+(l_linenumber-1)*5 as end_pos, l_linenumber as num_motifs,
       cast((cast(floor(l_extendedprice) as bigint) % 4001) - 2000 as double)/100 as llr from {source}
"""
_ALN = """
select l_orderkey as read_id, l_returnflag as contig, l_partkey as start_pos,
       l_partkey + cast(floor(l_quantity) as bigint) as end_pos, l_linenumber*8 as mapq, l_linenumber % 2 as is_rev, l_linestatus as rg
from {source}
"""
_VAR = """
select substr('ANR', cast(p_partkey % 3 as int)+1, 1) as contig, p_partkey + p_size as pos,
       substr('ACGT', cast(p_partkey % 4 as int)+1,1) as ref, substr('ACGT', cast((p_partkey+1+p_size % 3) % 4 as int)+1,1) as alt,
       p_retailprice as qual, case p_size % 3 when 0 then '0/0' when 1 then '0/1' else '1/1' end as gt from {source}
"""
_CIGAR = """
select l_orderkey as read_id, l_linenumber as line, l_partkey as pos,
       concat(l_linenumber,'S',cast(floor(l_quantity) as bigint),'M',l_suppkey % 4 + 1,'I',l_partkey % 3 + 1,'D',l_linenumber+3,'M') as cigar from {source}
"""
_MODEL = """
select {id} as rank, concat(substr('ACGT',cast(floor({id}/16) as int)+1,1),substr('ACGT',cast(floor({id}/4) as int)%4+1,1),
       substr('ACGT',cast({id}%4 as int)+1,1)) as kmer, cast(60+({id}*37)%60 as double) as level_mean, cast(1+({id}%5)*0.5 as double) as level_stdv
from range(64)
"""

#: name -> (source table, Spark's SQL, DuckDB's SQL)
VIEWS = {
    "v_seq": ("documents", "select doc_id as read_id, " + _FOLD.format("text", "") + " as seq from {source}", "select doc_id as read_id, " + _FOLD.format("text", ",'g'") + " as seq from documents"),
    "v_ref": ("benchmark", "select item_id as contig, " + _FOLD.format("text", "") + " as seq from {source}", "select item_id as contig, " + _FOLD.format("text", ",'g'") + " as seq from benchmark"),
    "v_events": ("events", _EVENTS.replace("{us}", "unix_micros(cast(ts as timestamp))"), _EVENTS.replace("{us}", "epoch_us(ts)").replace("{source}", "events")),
    "v_signal": ("embeddings", "select vec_id as read_id, transform(embedding, x -> cast(floor(9000 + 4000*cast(x as double)) as bigint)) as samples from {source}", "select vec_id as read_id, list_transform(embedding, lambda x: cast(floor(9000 + 4000*cast(x as double)) as bigint)) as samples from embeddings"),
    "v_calls": ("lineitem", _CALLS, _CALLS.replace("{source}", "lineitem")),
    "v_aln": ("lineitem", _ALN, _ALN.replace("{source}", "lineitem")),
    "v_var": ("part", _VAR, _VAR.replace("{source}", "part")),
    "v_cigar": ("lineitem", _CIGAR, _CIGAR.replace("{source}", "lineitem")),
    "v_model": (None, _MODEL.replace("{id}", "id"), _MODEL.replace("{id}", "range")),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, query, _ = VIEWS[name]
    if source is None:
        return spark.sql(query)
    return spark.sql(query, source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def sql(query: str, *names: str) -> str:
    """DuckDB's SQL with the named views in front."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][2]})" for n in names) + ("," if query.lstrip().startswith("--with") else "") + "\n" + query.replace("--with", "", 1)

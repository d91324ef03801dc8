"""seqnet: sparse dependency networks over ordered groups of sequences, as Spark jobs."""

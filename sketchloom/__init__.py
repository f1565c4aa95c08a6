"""Set-sketch analytics on Spark: inverted indexes, all-pairs similarity, de-replication, k-mer hashing."""

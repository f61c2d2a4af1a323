"""Source-corpus analytics on Spark: scans, import graphs, detectors, features, ranking and retrieval as DataFrames."""

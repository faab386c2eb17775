"""skein: typed, higher-order dataflow graphs compiled to Spark DataFrame plans."""

"""Registry analytics on Spark: typed normalisation, decision algebra, rules, matching, lifecycle and evaluation."""

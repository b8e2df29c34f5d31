"""factloom: fact reconciliation and corpus preparation expressed as Spark plans."""

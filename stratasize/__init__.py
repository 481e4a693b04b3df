"""Storage sizing from virtual-machine inventories, as Spark DataFrame operators."""

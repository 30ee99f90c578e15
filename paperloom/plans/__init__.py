"""The engine's operators applied to the driver's tables. Importing a module registers its queries."""

"""rareflow.functions"""

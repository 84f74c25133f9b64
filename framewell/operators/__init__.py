"""framewell.operators"""

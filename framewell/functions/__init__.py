"""framewell.functions"""

"""framewell.sources"""
